"""Mixtures with responses of several families: distributed EM, a job for each round.

Each family gives its log density as a column and the sums that its next
parameters need. Several responses of a row multiply. Families with covariates
(``Regression``, ``LevelRegression``) take one step of reweighted least squares a
round, whose normal equations are sums as well. Only sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattweave.spread import spare
from wattweave.storage import cut_lineage


@dataclass(frozen=True)
class Poisson:
    """Counts; the density leaves out what is the same in all states."""

    column: str

    @property
    def columns(self) -> list[str]:
        return [self.column]

    def sums(self) -> dict[str, Column]:
        return {"y": F.col(self.column)}

    def update(self, n: float, s: dict[str, float]) -> dict[str, float]:
        return {"mean": max(s["y"] / n, 1e-9)}

    def log_density(self, p: dict[str, float]) -> Column:
        return F.col(self.column) * math.log(p["mean"]) - p["mean"]


@dataclass(frozen=True)
class Binomial(Poisson):
    """0 or 1."""

    def update(self, n: float, s: dict[str, float]) -> dict[str, float]:
        return {"p": min(max(s["y"] / n, 1e-9), 1 - 1e-9)}

    def log_density(self, p: dict[str, float]) -> Column:
        return F.col(self.column) * math.log(p["p"]) + (1 - F.col(self.column)) * math.log(1 - p["p"])


@dataclass(frozen=True)
class Gamma(Poisson):
    """Positive values; the shape by its closed approximation from the mean and the mean logarithm."""

    def sums(self) -> dict[str, Column]:
        return {"y": F.col(self.column), "log": F.log(F.greatest(F.col(self.column), F.lit(1e-300)))}

    def update(self, n: float, s: dict[str, float]) -> dict[str, float]:
        mean = max(s["y"] / n, 1e-300)
        gap = max(math.log(mean) - s["log"] / n, 1e-9)
        shape = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
        return {"shape": shape, "scale": mean / shape}

    def log_density(self, p: dict[str, float]) -> Column:
        y = F.greatest(F.col(self.column), F.lit(1e-300))
        return (p["shape"] - 1) * F.log(y) - y / p["scale"] - (p["shape"] * math.log(p["scale"]) + math.lgamma(p["shape"]))


@dataclass(frozen=True)
class Multinomial:
    """One of the named levels; other values have no row in the fit."""

    column: str
    levels: Sequence

    @property
    def columns(self) -> list[str]:
        return [self.column]

    def sums(self) -> dict[str, Column]:
        return {str(x): (F.col(self.column) == x).cast("double") for x in self.levels}

    def update(self, n: float, s: dict[str, float]) -> dict[str, float]:
        p = {x: max(s[str(x)] / n, 1e-9) for x in self.levels}
        return {str(x): v / sum(p.values()) for x, v in p.items()}

    def log_density(self, p: dict[str, float]) -> Column:
        out = F.lit(None).cast("double")
        for x in self.levels:
            out = F.when(F.col(self.column) == x, math.log(p[str(x)])).otherwise(out)
        return out


class Normal:
    """One or several columns that are jointly normal, with a full covariance."""

    def __init__(self, *columns: str):
        self.columns = list(columns)

    def _pairs(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(len(self.columns)) for j in range(i + 1)]

    def sums(self) -> dict[str, Column]:
        y = [F.col(c) for c in self.columns]
        return {f"y{i}": c for i, c in enumerate(y)} | {f"y{i}y{j}": y[i] * y[j] for i, j in self._pairs()}

    def update(self, n: float, s: dict[str, float]) -> dict[str, float]:
        mean = {c: s[f"y{i}"] / n for i, c in enumerate(self.columns)}
        name, own = self.columns, {}
        for i, j in self._pairs():
            own[f"cov {name[i]} {name[j]}"] = s[f"y{i}y{j}"] / n - mean[name[i]] * mean[name[j]] + (1e-9 if i == j else 0.0)
        return {f"mean {c}": m for c, m in mean.items()} | own

    def log_density(self, p: dict[str, float]) -> Column:
        d, name = len(self.columns), self.columns
        cov = np.array([[p[f"cov {name[max(i, j)]} {name[min(i, j)]}"] for j in range(d)] for i in range(d)])
        inverse, off = np.linalg.inv(cov), [F.col(c) - p[f"mean {c}"] for c in name]
        square = sum((float(inverse[i, j]) * off[i] * off[j] for i in range(d) for j in range(d)), F.lit(0.0))
        return -0.5 * square - 0.5 * (float(np.linalg.slogdet(cov)[1]) + d * math.log(2 * math.pi))


def _linear(values: Sequence[float], x: Sequence[Column]) -> Column:
    return sum((float(v) * c for v, c in zip(values[1:], x, strict=True)), F.lit(float(values[0])))


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x = b with a little on the diagonal, so that a covariate without spread gets no slope."""
    ridge = 1e-10 * np.maximum(np.diagonal(a), 1e-10)
    return np.linalg.solve(a + np.diag(ridge), b) if np.linalg.cond(a + np.diag(ridge)) < 1e15 else np.linalg.pinv(a, rcond=1e-10) @ b


@dataclass(frozen=True)
class Regression:
    """A generalised linear model of one column on ``covariates``.

    ``family`` is gaussian (identity link), poisson (log), binomial (logit;
    ``trials`` names a column of trials, else 0/1) or gamma (``link`` log or
    inverse). Parameters are ``(intercept)``, the covariates, and ``sd`` or
    ``shape`` where the family has one.
    """

    column: str
    covariates: Sequence[str]
    family: str = "gaussian"
    link: str = "log"
    trials: str | None = None

    def __post_init__(self) -> None:
        if self.family not in ("gaussian", "poisson", "binomial", "gamma") or self.link not in ("log", "inverse"):
            raise ValueError(f"no family {self.family} with link {self.link}")

    @property
    def columns(self) -> list[str]:
        return [self.column, *self.covariates, *([self.trials] if self.trials else [])]

    @property
    def names(self) -> list[str]:
        return ["(intercept)", *self.covariates]

    def _y(self) -> Column:
        y = F.col(self.column).cast("double")
        return F.greatest(y, F.lit(1e-300)) if self.family == "gamma" else y

    def _n(self) -> Column:
        return F.col(self.trials).cast("double") if self.trials else F.lit(1.0)

    def _eta(self, p: dict[str, float]) -> Column:
        eta = _linear([p[n] for n in self.names], [F.col(c) for c in self.covariates])
        if self.family == "gamma" and self.link == "inverse":
            return F.greatest(eta, F.lit(1e-8))  # a mean is positive
        return F.least(F.greatest(eta, F.lit(-700.0)), F.lit(700.0)) if self.family != "gaussian" else eta

    def _working(self, p: dict[str, float] | None) -> tuple[Column, Column, Column]:
        """eta, the mean and its slope in eta; without parameters at the observations, drawn in a little."""
        y, n = self._y(), self._n()
        if self.family == "gaussian":
            eta = y if p is None else self._eta(p)
            return eta, eta, F.lit(1.0)
        if self.family == "binomial":
            share = (y + 0.5) / (n + 1.0) if p is None else 1 / (1 + F.exp(-self._eta(p)))
            share = F.least(F.greatest(share, F.lit(1e-10)), F.lit(1 - 1e-10))
            return F.log(share / (1 - share)), n * share, n * share * (1 - share)
        if self.family == "gamma" and self.link == "inverse":
            eta = 1 / y if p is None else self._eta(p)
            return eta, 1 / eta, -1 / (eta * eta)
        mean = (y + 0.1 if self.family == "poisson" else y) if p is None else F.exp(self._eta(p))
        return F.log(mean), mean, mean

    def sums(self, p: dict[str, float] | None = None) -> dict[str, Column]:
        """The weighted normal equations at ``p``, and what the spread needs."""
        eta, mean, slope = self._working(p)
        spread = {"gaussian": F.lit(1.0), "poisson": mean, "binomial": slope, "gamma": mean * mean}[self.family]
        weight, aim = slope * slope / spread, eta + (self._y() - mean) / slope
        x = [F.lit(1.0), *(F.col(c).cast("double") for c in self.covariates)]
        out = {f"a{i} {j}": weight * x[i] * x[j] for i in range(len(x)) for j in range(i + 1)} | {f"b{i}": weight * aim * x[i] for i in range(len(x))}
        if self.family == "gaussian":
            out["yy"] = aim * aim
        if self.family == "gamma":
            ratio = self._y() / mean
            out["gap"] = ratio - F.log(F.greatest(ratio, F.lit(1e-300))) - 1
        return out

    def update(self, n: float, s: dict[str, float], p: dict[str, float] | None = None) -> dict[str, float]:
        m = len(self.names)
        a = np.array([[s[f"a{max(i, j)} {min(i, j)}"] for j in range(m)] for i in range(m)])
        b = np.array([s[f"b{i}"] for i in range(m)])
        beta = _solved(a, b)
        out = dict(zip(self.names, map(float, beta), strict=True))
        if self.family == "gaussian":
            out["sd"] = math.sqrt(max((s["yy"] - 2 * beta @ b + beta @ a @ beta) / n, 1e-12))
        if self.family == "gamma":
            gap = max(s["gap"] / n, 1e-9) if p else 0.5
            out["shape"] = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
        return out

    def between(self, p: dict[str, float], q: dict[str, float]) -> dict[str, float]:
        """``p`` with its coefficients half way back to those of ``q``."""
        return p | {n: (p[n] + q[n]) / 2 for n in self.names}

    def log_density(self, p: dict[str, float]) -> Column:
        y, n, eta = self._y(), self._n(), self._eta(p)
        if self.family == "gaussian":
            return -0.5 * ((y - eta) / p["sd"]) * ((y - eta) / p["sd"]) - (math.log(p["sd"]) + 0.5 * math.log(2 * math.pi))
        if self.family == "poisson":
            return y * eta - F.exp(eta)
        if self.family == "binomial":
            return y * eta - n * (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))))
        k, mean = p["shape"], F.exp(eta) if self.link == "log" else 1 / eta
        return (k - 1) * F.log(y) - k * y / mean - k * F.log(mean) + (k * math.log(k) - math.lgamma(k))


@dataclass(frozen=True)
class LevelRegression:
    """Multinomial logits of the named levels on ``covariates``, against the first level."""

    column: str
    levels: Sequence
    covariates: Sequence[str]

    @property
    def columns(self) -> list[str]:
        return [self.column, *self.covariates]

    @property
    def names(self) -> list[str]:
        return [f"{x} {c}" for x in self.levels[1:] for c in ["(intercept)", *self.covariates]]

    def _logits(self, p: dict[str, float] | None) -> list[Column]:
        x = [F.col(c) for c in self.covariates]
        at = p or dict.fromkeys(self.names, 0.0)
        return [F.lit(0.0), *(_linear([at[f"{v} {c}"] for c in ["(intercept)", *self.covariates]], x) for v in self.levels[1:])]

    def _shares(self, p: dict[str, float] | None) -> list[Column]:
        logits = self._logits(p)
        top = F.greatest(*logits) if len(logits) > 1 else logits[0]
        return [F.exp(z - top) / sum((F.exp(o - top) for o in logits[1:]), F.exp(logits[0] - top)) for z in logits]

    def sums(self, p: dict[str, float] | None = None) -> dict[str, Column]:
        """Gradient and information at ``p``."""
        x = [F.lit(1.0), *(F.col(c).cast("double") for c in self.covariates)]
        share = self._shares(p)[1:]
        hit = [(F.col(self.column) == v).cast("double") for v in self.levels[1:]]
        out = {f"g{a} {i}": (hit[a] - share[a]) * x[i] for a in range(len(share)) for i in range(len(x))}
        for a in range(len(share)):
            for b in range(a + 1):
                weight = share[a] * ((1.0 if a == b else 0.0) - share[b])
                out |= {f"h{a} {b} {i} {j}": weight * x[i] * x[j] for i in range(len(x)) for j in range(i + 1)}
        return out

    def update(self, n: float, s: dict[str, float], p: dict[str, float] | None = None) -> dict[str, float]:
        m, k = len(self.covariates) + 1, len(self.levels) - 1
        cell = lambda a, b, i, j: s[f"h{max(a, b)} {min(a, b)} {max(i, j)} {min(i, j)}"]
        h = np.array([[cell(a, b, i, j) for b in range(k) for j in range(m)] for a in range(k) for i in range(m)])
        g = np.array([s[f"g{a} {i}"] for a in range(k) for i in range(m)])
        held = np.array([(p or {}).get(name, 0.0) for name in self.names])
        return dict(zip(self.names, map(float, held + np.clip(_solved(h, g), -5, 5)), strict=True)) if k else {}

    def between(self, p: dict[str, float], q: dict[str, float]) -> dict[str, float]:
        return {n: (p[n] + q[n]) / 2 for n in self.names}

    def log_density(self, p: dict[str, float]) -> Column:
        logits = self._logits(p)
        top = F.greatest(*logits) if len(logits) > 1 else logits[0]
        norm = top + F.log(sum((F.exp(o - top) for o in logits[1:]), F.exp(logits[0] - top)))
        out = F.lit(None).cast("double")
        for v, z in zip(self.levels, logits, strict=True):
            out = F.when(F.col(self.column) == v, z).otherwise(out)
        return out - norm


REGRESSIONS = (Regression, LevelRegression)


def fit_families(df: DataFrame, k: int, responses: Sequence, iterations: int = 20, tol: float = 1e-6) -> DataFrame:
    """state, weight, response, parameter, value of a mixture of ``k`` classes without time order, over all rows.

    Rows that lack one of the responses' columns are left out. Starts from slices
    of the first column's order (by approximate quantiles; a name's place among
    its levels), loosely assigned. Ends when the log-likelihood rises by less than
    a share of ``tol``, or after ``iterations`` rounds. Where a step of regressions
    lowers it, they go half way back, ten times at most. Classes are sorted by
    weight, the largest first. An empty table gives an empty result.
    """
    schema = "state int, weight double, response string, parameter string, value double"
    names = sorted({c for r in responses for c in r.columns})
    rows = df.select(*names).dropna()
    for r in responses:
        if isinstance(r, (Multinomial, LevelRegression)):
            rows = rows.where(F.col(r.column).isin(list(r.levels)))
    lead, first = F.col(responses[0].columns[0]), responses[0]
    if isinstance(first, (Multinomial, LevelRegression)):
        lead = F.array_position(F.array(*map(F.lit, first.levels)), lead)
    cuts = rows.agg(F.percentile_approx(lead.cast("double"), [(j + 1) / k for j in range(k)]).alias("q")).first()["q"]
    if cuts is None:
        return df.sparkSession.createDataFrame([], schema)
    (m,) = spare(rows, "m")
    rows = cut_lineage(rows.groupBy(*names).agg(F.count(F.lit(1)).alias(m)))  # rows that are alike count as one, m times; rounds read this table
    slot = sum(((lead > c).cast("int") for c in cuts[:-1]), F.lit(0))
    shares = [F.when(slot == j, 0.8 if k > 1 else 1.0).otherwise(0.2 / max(k - 1, 1)) for j in range(k)]
    moving = any(isinstance(r, REGRESSIONS) for r in responses)
    gained, last, states, before, backs = F.lit(None).cast("double"), None, [], [], 0
    of = lambda r, j, i: r.sums(states[j][1][i] if states else None) if isinstance(r, REGRESSIONS) else r.sums()
    for _ in range(iterations):
        sums = [F.sum(w * F.col(m)).alias(f"n{j}") for j, w in enumerate(shares)] + [F.sum(gained * F.col(m)).alias("loglik")]
        each = {(j, i): of(r, j, i) for j in range(k) for i, r in enumerate(responses)}
        sums += [F.sum(shares[j] * F.col(m) * e).alias(f"s{j} {i} {n}") for (j, i), own in each.items() for n, e in own.items()]
        told = rows.agg(*sums).first().asDict()
        rise = None if last is None else told["loglik"] - last
        if rise is not None and rise < -1e-9 * abs(last) and moving and before and backs < 10:
            backs += 1
            states = [(w, [r.between(p, q) if isinstance(r, REGRESSIONS) and q else p for r, p, q in zip(responses, own, then, strict=True)]) for (w, own), (_, then) in zip(states, before, strict=True)]
        elif rise is not None and rise <= tol * abs(last):
            break
        else:
            last, backs, before = told["loglik"], 0, states
            total, states = sum(told[f"n{j}"] for j in range(k)), []
            for j in range(k):
                n, own = max(told[f"n{j}"], 1e-9), []
                for i, r in enumerate(responses):
                    s = {name: told[f"s{j} {i} {name}"] for name in each[j, i]}
                    own.append(r.update(n, s, before[j][1][i] if before else None) if isinstance(r, REGRESSIONS) else r.update(n, s))
                states.append((n / total, own))
        logs = [sum((r.log_density(p) for r, p in zip(responses, own, strict=True)), F.lit(math.log(max(w, 1e-300)))) for w, own in states]
        top = F.greatest(*logs) if k > 1 else logs[0]
        norm = sum((F.exp(x - top) for x in logs[1:]), F.exp(logs[0] - top))
        shares, gained = [F.exp(x - top) / norm for x in logs], top + F.log(norm)
    states.sort(key=lambda s: -s[0])
    out = [(j + 1, w, r.column if isinstance(r, REGRESSIONS) else "+".join(r.columns), m, float(v)) for j, (w, own) in enumerate(states) for r, p in zip(responses, own, strict=True) for m, v in p.items()]
    return df.sparkSession.createDataFrame(out, schema)
