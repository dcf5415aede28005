"""Least squares over a moving-average recursion, for series of any length.

The shocks of an ARMA model follow one after another: e_t = z_t - c - phi z -
theta e. So do their derivatives, which a Gauss-Newton step needs. But a stretch
of rows maps the values before it to its own last values by an affine map, and
affine maps compose. Every block of rows gives its map, the maps of a series are
chained, and each block then runs from the values it starts with; inside a block
shorter runs do the same, so its rows are arrays and not steps.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import stage

#: Relative change of the squares at which a fit ends, evaluations at most, and first damping.
SETTLED, EVALUATIONS, DAMPING = 1e-15, 200, 1e-3


def recur(u: np.ndarray, theta: np.ndarray, past: np.ndarray) -> np.ndarray:
    """v_t = u_t - theta_1 v_(t-1) - ... per column; row j of ``past`` is v_(-1-j)."""
    q, (n, m) = len(theta), u.shape
    if not q or not n:
        return u.copy()
    run = max(q, math.isqrt(n))
    runs = -(-n // run)
    v = np.zeros((runs * run, m))
    v[:n] = u
    v = v.reshape(runs, run, m)
    alone = np.zeros((run, q))  # what each past value makes of zeros
    with np.errstate(over="ignore", invalid="ignore"):
        for t in range(run):
            for j in range(q):
                if t > j:
                    v[:, t] -= theta[j] * v[:, t - 1 - j]
                    alone[t] -= theta[j] * alone[t - 1 - j]
                else:
                    alone[t, j - t] -= theta[j]
        for r in range(runs):
            v[r] += alone @ past
            past = v[r, run - q :][::-1]
    return v.reshape(-1, m)[:n]


def _last(v: np.ndarray, past: np.ndarray, q: int) -> np.ndarray:
    """The last ``q`` rows of ``v``, newest first, going on into ``past``."""
    return np.concatenate([v[::-1][:q], past])[:q]


def _inputs(e: np.ndarray, past: np.ndarray, q: int) -> np.ndarray:
    """The lagged shocks e_(t-1) ... e_(t-q) as columns."""
    long = np.concatenate([past[::-1], e])
    return np.stack([long[q - j : q - j + len(e)] for j in range(1, q + 1)], axis=1) if q else np.zeros((len(e), 0))


def shocks(z: np.ndarray, beta: np.ndarray, p: int, q: int, past: np.ndarray, own: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Shocks and their derivatives by (c, phi, theta); ``z`` has the value and its p lags in columns.

    ``past`` has the last q shocks and derivatives, newest first, shocks in
    column 0. Without ``own`` the rows bring no input: what remains of the past.
    """
    theta = beta[1 + p :]
    u = (z[:, 0] - beta[0] - z[:, 1:] @ beta[1 : 1 + p]) if own else np.zeros(len(z))
    e = recur(u[:, None], theta, past[:, :1])[:, 0]
    fixed = -np.concatenate([np.ones((len(z), 1)), z[:, 1:]], axis=1) if own else np.zeros((len(z), 1 + p))
    return e, recur(np.concatenate([fixed, -_inputs(e, past[:, 0], q)], axis=1), theta, past[:, 1:])


def sums(e: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Squares, derivatives times shocks, and derivatives squared, as one vector."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.concatenate([[e @ e], g.T @ e, (g.T @ g).ravel()])


def improved(beta: np.ndarray, best: np.ndarray, damping: float, trial: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, bool]:
    """After the squares at ``trial`` are known: parameters, their sums, damping, the next trial, and whether the fit has settled."""
    k = len(beta)
    settled = False
    if np.isfinite(found).all() and found[0] <= best[0]:
        settled = np.isfinite(best[0]) and best[0] - found[0] <= SETTLED * best[0]
        beta, best, damping = trial, found, damping / 10
    else:
        damping *= 10
        settled = damping > 1e12 or np.abs(trial - beta).max() <= 1e-11 * (1 + np.abs(beta).max())
    if not np.isfinite(best[0]):
        return beta, best, damping, beta / 2, damping > 1e12
    normal = best[1 + k :].reshape(k, k)
    scale = np.diag(np.maximum(np.diag(normal), 1e-300))
    return beta, best, damping, beta - np.linalg.lstsq(normal + damping * scale, best[1 : 1 + k], rcond=None)[0], bool(settled)


def fit(rows: DataFrame, start: DataFrame, p: int, q: int, block_rows: int) -> DataFrame:
    """``(s, n, beta, sse, recent)``: per series the least-squares parameters (c, phi, theta) and the last q shocks.

    rows(s, place, z): places from 0 and the value with its p lags; shocks before
    place 0 are zero. start(s, beta). A series of one block is fitted where it
    lies; longer ones take part in jobs over all blocks, one an evaluation.
    """
    k = 1 + p + q
    head = "s string, n long, beta array<double>, sse double, recent array<double>"
    blocks = stage(rows.withColumn("block", F.floor(F.col("place") / block_rows)))
    long = stage(blocks.filter("block > 0").select("s").distinct())
    one = blocks.join(long, "s", "left_anti")

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        frame = frame.sort_values("place")
        return np.stack(frame["z"].to_numpy()).astype(float)

    def here(key, frame: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(first):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in head.split(", ")})
        z, none = matrix(frame), np.zeros((q, 1 + k))
        beta = trial = np.asarray(first["beta"].iloc[0], float)
        best, damping, settled = np.full(1 + k + k * k, np.inf), DAMPING, False
        for _ in range(EVALUATIONS):
            beta, best, damping, trial, settled = improved(beta, best, damping, trial, sums(*shocks(z, trial, p, q, none)))
            if settled:
                break
        e, _ = shocks(z, beta, p, q, none)
        return pd.DataFrame({"s": [key[0]], "n": [len(z)], "beta": [beta.tolist()], "sse": [float(best[0])], "recent": [_last(e, np.zeros(q), q).tolist()]})

    short = one.groupBy("s").cogroup(start.groupBy("s")).applyInPandas(here, head)
    if long.isEmpty():
        return short
    return short.unionByName(_fit_blocks(blocks.join(long, "s", "left_semi"), start.join(long, "s", "left_semi"), p, q, matrix))


def _fit_blocks(blocks: DataFrame, start: DataFrame, p: int, q: int, matrix) -> DataFrame:
    k = 1 + p + q
    none = np.zeros((q, 1 + k))

    def response(key, frame: pd.DataFrame) -> pd.DataFrame:
        """Of a block: its last values from a zero past, and from each past value alone."""
        z, beta = matrix(frame), np.asarray(frame["trial"].iloc[0], float)
        out = []
        for j in range(-1, q):
            past = none.copy()
            if j >= 0:
                past[j, 0] = 1
            e, g = shocks(z, beta, p, q, past, own=j < 0)
            out.append(_last(np.concatenate([e[:, None], g], axis=1), past, q))
        return pd.DataFrame({"s": [key[0]], "block": [key[1]], "map": [np.stack(out).ravel().tolist()]})

    def chain(key, frame: pd.DataFrame) -> pd.DataFrame:
        """What each block of a series starts from; a map is a few numbers."""
        frame, past, out = frame.sort_values("block"), none, []
        for flat in frame["map"]:
            out.append(past.ravel().tolist())
            both = np.asarray(flat, float).reshape(q + 1, q, 1 + k)
            with np.errstate(over="ignore", invalid="ignore"):
                # A derivative's own past fades as a shock's does: column 0 of the answers.
                past = both[0] + np.einsum("j,jic->ic", past[:, 0], both[1:]) + np.pad(both[1:, :, 0].T @ past[:, 1:], ((0, 0), (1, 0)))
        return pd.DataFrame({"s": [key[0]] * len(out), "block": frame["block"].to_numpy(), "past": out})

    def squares(key, frame: pd.DataFrame) -> pd.DataFrame:
        z, beta = matrix(frame), np.asarray(frame["trial"].iloc[0], float)
        past = np.asarray(frame["past"].iloc[0], float).reshape(q, 1 + k)
        e, g = shocks(z, beta, p, q, past)
        return pd.DataFrame({"s": [key[0]], "block": [key[1]], "n": [len(z)], "v": [sums(e, g).tolist()], "recent": [_last(e, past[:, 0], q).tolist()]})

    def evaluated(at: DataFrame) -> DataFrame:
        """(s, n, found, last) at each series' ``trial``."""
        placed = blocks.join(at.select("s", "trial"), "s")
        maps = placed.groupBy("s", "block").applyInPandas(response, "s string, block long, map array<double>")
        pasts = maps.groupBy("s").applyInPandas(chain, "s string, block long, past array<double>")
        each = placed.join(pasts, ["s", "block"]).groupBy("s", "block").applyInPandas(squares, "s string, block long, n long, v array<double>, recent array<double>")
        ends = each.groupBy("s").agg(F.sum("n").alias("n"), F.max_by("recent", "block").alias("last"))
        whole = each.select("s", F.posexplode("v").alias("i", "x")).groupBy("s", "i").agg(F.sum("x").alias("x"))
        whole = whole.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("found"))
        return ends.join(whole, "s")

    state = "s string, beta array<double>, best array<double>, damping double, trial array<double>, settled boolean, n long, recent array<double>"

    def step(frames):
        for frame in frames:
            if not len(frame):
                continue
            out = []
            for r in frame.itertuples(index=False):
                best = np.asarray(r.best, float)
                beta, sums_, damping, trial, settled = improved(np.asarray(r.beta, float), best, r.damping, np.asarray(r.trial, float), np.asarray(r.found, float))
                taken = sums_ is not best
                out.append((r.s, beta.tolist(), sums_.tolist(), damping, trial.tolist(), settled, int(r.n), list(r.last if taken else r.recent)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in state.split(", ")])

    worst = F.array_repeat(F.lit(float("inf")), 1 + k + k * k)
    now = start.select(
        "s", "beta", worst.alias("best"), F.lit(DAMPING).alias("damping"), F.col("beta").alias("trial"),
        F.lit(False).alias("settled"), F.lit(0).cast("long").alias("n"), F.array_repeat(F.lit(0.0), q).alias("recent"),
    )
    done = None
    for _ in range(EVALUATIONS):
        at = now.drop("n").join(evaluated(now), "s")
        now = stage(at.mapInPandas(step, state))
        ended = now.filter("settled")
        done = ended if done is None else done.unionByName(ended)
        now = now.filter("NOT settled")
        if now.isEmpty():
            break
    else:
        done = done.unionByName(now)
    return done.select("s", "n", "beta", F.col("best")[0].alias("sse"), "recent")
