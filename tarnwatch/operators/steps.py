"""Per-key state machines; each is one class, used by batch folds and by streams alike."""

from __future__ import annotations

import functools
import hashlib
import heapq
import hmac
import json
import math
from bisect import insort
from dataclasses import dataclass, field

import numpy as np

from ..plans.fold import Step


def _finite(v) -> bool:
    return v is not None and math.isfinite(v)


@dataclass
class Ema(Step):
    """Exponential mean and variance: ``var = (1-d)(var + d*delta^2)``; the first value sets the mean."""

    decay: float = 0.01
    n: int = 0
    mean: float = 0.0
    var: float = 0.0
    fields = (("mean", "double"), ("variance", "double"), ("n", "long"))

    def __post_init__(self):
        if not 0 < self.decay < 1:
            raise ValueError("decay between 0 and 1")

    def take(self, v: float) -> None:
        if not _finite(v):
            return
        if self.n == 0:
            self.mean = v
        else:
            delta = v - self.mean
            self.mean += self.decay * delta
            self.var = (1 - self.decay) * (self.var + self.decay * delta * delta)
        self.n += 1

    def update(self, value):
        self.take(value)
        return self.mean, self.var, self.n


@dataclass
class Ewma(Step):
    """z-score against the state before the update; none during warm-up."""

    alpha: float = 0.01
    warmup: int = 100
    n: int = 0
    mean: float = 0.0
    var: float = 0.0
    fields = (("z", "double"),)

    def update(self, value):
        z = None
        if not _finite(value):
            return (None,)
        delta = value - self.mean
        if self.n >= self.warmup:
            std = math.sqrt(self.var)
            z = abs(delta) / std if std >= 2.220446049250313e-16 else (0.0 if abs(delta) < 2.220446049250313e-16 else 1.7976931348623157e308)
        if self.n == 0:
            self.mean = value
        else:
            self.mean += self.alpha * delta
            self.var = self.alpha * delta * delta + (1 - self.alpha) * self.var
        self.n += 1
        return (z,)


@dataclass
class EwmaPoint(Step):
    """:class:`Ewma` of every dimension of a point, and the largest z; none of either during warm-up."""

    alpha: float = 0.01
    warmup: int = 100
    n: int = 0
    parts: list = field(default_factory=list)
    inputs = ("features",)
    fields = (("max_z", "double"), ("z", "array<double>"))

    def update(self, features):
        self.parts = self.parts or [Ewma(self.alpha, 0) for _ in features]
        if len(features) != len(self.parts):
            raise ValueError("points of one width")
        zs = [part.update(v)[0] for part, v in zip(self.parts, features, strict=True)]
        self.n += 1
        if self.n <= self.warmup:
            return None, None
        return max([0.0, *[z for z in zs if z is not None]]), zs


@dataclass
class MetaDrift(Step):
    """CUSUM of a score stream against its own EMA, frozen until it is ready."""

    k: float = 0.5
    h: float = 5.0
    min_observations: int = 32
    decay: float = 0.01
    s_high: float = 0.0
    s_low: float = 0.0
    ema: Ema | None = None
    fields = (("s_high", "double"), ("s_low", "double"), ("threshold", "double"), ("ready", "boolean"), ("drift", "string"))

    def update(self, value):
        self.ema = self.ema or Ema(self.decay)
        std = math.sqrt(self.ema.var)
        ready = self.ema.n >= self.min_observations and std > 0
        drift, threshold = None, self.h * std
        if ready and _finite(value):
            dev = value - self.ema.mean
            self.s_high = max(0.0, self.s_high + dev - self.k * std)
            self.s_low = max(0.0, self.s_low - dev - self.k * std)
            drift = "Upward" if self.s_high > threshold else "Downward" if self.s_low > threshold else None
        self.ema.take(value)
        return self.s_high, self.s_low, threshold, ready, drift


class Digest:
    """t-digest: centroids bounded by an arcsine scale; merges with digests of the same compression."""

    def __init__(self, compression: float = 100.0):
        if not 2 <= compression <= 10_000:
            raise ValueError("compression 2 to 10,000")
        self.compression, self.means, self.weights, self.buffer = compression, np.zeros(0), np.zeros(0), []
        self.min, self.max = math.inf, -math.inf

    def record(self, v: float, weight: float = 1.0) -> None:
        if _finite(v):
            self.buffer.append((v, weight))
            self.min, self.max = min(self.min, v), max(self.max, v)
            if len(self.buffer) >= 10 * self.compression:
                self.flush()

    def record_many(self, values) -> None:
        """Many values at once; compresses whenever the buffer is full."""
        v = np.asarray(values, float)
        v = v[np.isfinite(v)]
        if not len(v):
            return
        self.min, self.max = min(self.min, float(v.min())), max(self.max, float(v.max()))
        room = int(10 * self.compression)
        for k in range(0, len(v), room):
            self.buffer += [(x, 1.0) for x in v[k : k + room].tolist()]
            if len(self.buffer) >= room:
                self.flush()

    @property
    def weight(self) -> float:
        return float(self.weights.sum()) + sum(w for _, w in self.buffer)

    def flush(self) -> None:
        if not self.buffer:
            return
        v = np.concatenate([self.means, [b[0] for b in self.buffer]])
        w = np.concatenate([self.weights, [b[1] for b in self.buffer]])
        order = np.argsort(v, kind="stable")
        v, w, self.buffer = v[order], w[order], []
        whole, means, weights = w.sum(), [], []
        limit = lambda q: (math.sin(min(math.pi / 2, math.asin(2 * q - 1) + 2 * math.pi / self.compression)) + 1) / 2
        mean, weight, before = v[0], w[0], 0.0
        upto = limit(0.0)
        for x, c in zip(v[1:].tolist(), w[1:].tolist(), strict=True):
            if (before + weight + c) / whole <= upto:
                weight += c
                mean += (x - mean) * c / weight
            else:
                means.append(mean)
                weights.append(weight)
                before += weight
                upto = limit(min(1.0, before / whole))
                mean, weight = x, c
        self.means, self.weights = np.array([*means, mean]), np.array([*weights, weight])

    def quantile(self, q: float) -> float | None:
        self.flush()
        if not len(self.means):
            return None
        if len(self.means) == 1 or q <= 0 or q >= 1:
            return self.min if q <= 0 else self.max if q >= 1 else float(self.means[0])
        middle = np.cumsum(self.weights) - self.weights / 2
        at = q * self.weights.sum()
        return float(np.interp(at, np.concatenate([[0], middle, [self.weights.sum()]]), np.concatenate([[self.min], self.means, [self.max]])))

    def merge(self, other: Digest) -> None:
        if other.compression != self.compression:
            raise ValueError("digests of different compression")
        other.flush()
        for m, w in zip(other.means.tolist(), other.weights.tolist(), strict=True):
            self.buffer.append((m, w))
        self.min, self.max = min(self.min, other.min), max(self.max, other.max)
        self.flush()


@dataclass
class Threshold(Step):
    """Grades a score stream: the grade uses the statistics before the score is recorded."""

    mode: str = "zsigma"
    z: float = 3.0
    p: float = 0.99
    decay: float = 0.01
    min_observations: int = 32
    min_threshold: float = 1.0
    skip_first: bool = True
    first: bool = True
    ema: Ema | None = None
    digest: Digest | None = None
    fields = (("threshold", "double"), ("grade", "double"), ("is_anomaly", "boolean"), ("ready", "boolean"))

    def __post_init__(self):
        if self.mode not in ("zsigma", "quantile"):
            raise ValueError(self.mode)
        if not (0 < self.z < math.inf and 0 < self.p < 1 and self.min_observations >= 0 and 0 <= self.min_threshold < math.inf):
            raise ValueError("a positive z, p between 0 and 1, and finite minima from 0 on")
        self.ema = self.ema or Ema(self.decay)
        if self.mode == "quantile":
            self.digest = self.digest or Digest()

    def grade(self, v: float):
        if self.ema.n < self.min_observations:
            return self.min_threshold, 0.0, False, False
        if self.mode == "zsigma":
            std = math.sqrt(self.ema.var)
            if std <= 0:
                return self.min_threshold, 0.0, False, False
            limit, span = max(self.ema.mean + self.z * std, self.min_threshold), self.z * std
        else:
            limit = max(self.digest.quantile(self.p), self.min_threshold)
            span = max(self.digest.max - limit, 2.220446049250313e-16)
        if v <= limit:
            return limit, 0.0, False, True
        return limit, min(1.0, max(0.0, (v - limit) / span)), True, True

    def standing(self) -> tuple:
        """Observations, mean, variance, and the threshold, span and readiness that the next score meets."""
        limit, _, _, ready = self.grade(-math.inf)
        span = None
        if ready:
            span = self.z * math.sqrt(self.ema.var) if self.mode == "zsigma" else max(self.digest.max - limit, 2.220446049250313e-16)
        return self.ema.n, self.ema.mean, self.ema.var, limit, span, ready

    def update(self, value):
        if not _finite(value):
            return self.min_threshold, 0.0, False, False
        if self.first and self.skip_first:
            self.first = False
            return self.min_threshold, 0.0, False, False
        out = self.grade(value)
        self.ema.take(value)
        if self.digest:
            self.digest.record(value)
        return out


@dataclass
class Adwin(Step):
    """Adaptive window: the first split whose halves differ by more than the bound drops the older half."""

    delta: float = 0.002
    cap: int = 4096
    min_half: int = 16
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    fires: int = 0
    fields = (("drift", "boolean"), ("window_mean", "double"), ("window_length", "long"), ("fires", "long"))

    def __post_init__(self):
        if not (0 < self.delta < 1 and self.cap >= 2 * self.min_half >= 2):
            raise ValueError("delta between 0 and 1, and room for two halves")
        # the window is a slice of a buffer of twice the cap, moved to its front when it reaches the end
        self.values = np.asarray(self.values, float)

    def update(self, value):
        fired = False
        if _finite(value):
            self._append(value)
            v = self.values
            n = len(v)
            if n >= 2 * self.min_half:
                sums = np.cumsum(v)
                n0 = self._ramp(n)[self.min_half : n - self.min_half + 1]
                head = sums[self.min_half - 1 : n - self.min_half]
                n1 = n - n0
                spread = v.max() - v.min()
                hit = np.abs(head / n0 - (sums[-1] - head) / n1) > spread * np.sqrt(math.log(4 * n / self.delta) / 2 * (1 / n0 + 1 / n1))
                k = int(hit.argmax())
                if spread > 0 and hit[k]:
                    self.values = v[int(n0[k]) :]
                    fired, self.fires = True, self.fires + 1
        mean = float(np.mean(self.values)) if len(self.values) else 0.0
        return fired, mean, len(self.values), self.fires

    def _append(self, value: float) -> None:
        held = self.__dict__.get("_room")
        n = len(self.values)
        end = self.__dict__.get("_end", 0)
        if held is None or end == len(held) or self.values.base is not held:
            held = np.zeros(2 * self.cap + 1)
            held[:n] = self.values
            end = n
        held[end] = value
        self._room, self._end = held, end + 1
        self.values = held[max(end + 1 - min(n + 1, self.cap), 0) : end + 1]

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def _whole(cap: int) -> np.ndarray:
        return np.arange(cap + 1, dtype=float)

    def _ramp(self, n: int) -> np.ndarray:
        return self._whole(max(n, self.cap))


@dataclass
class Spot(Step):
    """Peaks over threshold: the first ``calibrate`` values fix the quantile, the rest feed excesses.

    With ``calibrate`` None the quantile rolls with all values until :meth:`freeze_baseline` pins it."""

    q: float = 0.98
    alert_p: float = 1e-3
    calibrate: int | None = 100
    seen: int = 0
    u: float | None = None
    peaks: int = 0
    mean: float = 0.0
    m2: float = 0.0
    digest: Digest | None = None
    frozen: bool = False
    fields = (("p_value", "double"), ("is_anomaly", "boolean"))

    def p_value(self, v: float) -> float:
        if self.u is None or v <= self.u:
            return 1.0
        x, few = v - self.u, max(1 / max(1, self.seen), 1 - self.q)
        var = self.m2 / (self.peaks - 1) if self.peaks > 1 else 0.0
        if self.peaks < 16:
            return few
        gamma = min(0.4999, max(-5.0, 0.5 * (1 - self.mean**2 / var))) if var > 0 else 0.0
        sigma = self.mean * (1 + gamma)
        if sigma <= 0:
            return few
        base = 1 + gamma * x / sigma
        tail = math.exp(-x / sigma) if abs(gamma) < 1e-9 else 0.0 if base <= 0 else base ** (-1 / gamma)
        return max((1 - self.q) * tail, 1 / (1000 * self.seen))

    def update(self, value):
        if not _finite(value):
            return 1.0, False
        self.digest = self.digest or Digest()
        if self.calibrate is None and not self.frozen:
            p = self.p_value(value)
            self.seen += 1
            self.digest.record(value)
            self.u = self.digest.quantile(self.q)
            self._peak(value)
            return p, p < self.alert_p
        if self.u is None:
            self.digest.record(value)
            self.seen += 1
            if self.seen >= self.calibrate:
                self.u = self.digest.quantile(self.q)
            return 1.0, False
        p = self.p_value(value)
        self.seen += 1
        self._peak(value)
        return p, p < self.alert_p

    def _peak(self, value: float) -> None:
        if value > self.u:
            self.peaks += 1
            delta = value - self.u - self.mean
            self.mean += delta / self.peaks
            self.m2 += delta * (value - self.u - self.mean)

    def freeze_baseline(self) -> None:
        """Pins the present quantile; the excesses begin anew."""
        if self.digest is None or (u := self.digest.quantile(self.q)) is None:
            raise ValueError("no values yet")
        self.u, self.frozen, self.peaks, self.mean, self.m2 = u, True, 0, 0.0, 0.0


@dataclass
class RateCap(Step):
    """At most ``cap`` admissions per window and bucket; a window is anchored at its first event."""

    cap: int = 100
    window_ms: int = 1000
    start: int | None = None
    admitted: int = 0
    inputs = ("now_ms",)
    fields = (("admitted", "boolean"), ("window_start", "long"))

    def update(self, now_ms):
        if self.cap <= 0:  # disabled: all pass
            return True, None
        if self.start is None or now_ms - self.start >= self.window_ms:
            self.start, self.admitted = now_ms, 0
        self.admitted += 1
        return self.admitted <= self.cap, self.start


@dataclass
class SpaceSaving(Step):
    """Top keys in bounded counters: a new key takes over the smallest counter and its count as error."""

    capacity: int = 128
    counts: dict = field(default_factory=dict)
    total: int = 0
    inputs = ("item",)
    fields = (("estimate", "long"), ("error", "long"))

    def update(self, item, weight: int = 1):
        heap = self.__dict__.get("_heap")
        if heap is None or len(heap) > 8 * self.capacity + 64:
            heap = self._heap = [(c, str(k), k) for k, (c, _) in self.counts.items()]
            heapq.heapify(heap)
        self.total += weight
        if item in self.counts:
            self.counts[item][0] += weight
        elif len(self.counts) < self.capacity:
            self.counts[item] = [weight, 0]
        else:
            while True:  # entries of counts that have grown since go back in
                least, _, victim = heapq.heappop(heap)
                if victim in self.counts:
                    if self.counts[victim][0] == least:
                        break
                    heapq.heappush(heap, (self.counts[victim][0], str(victim), victim))
            del self.counts[victim]
            self.counts[item] = [least + weight, least]
        if self.counts[item][0] == weight + self.counts[item][1]:  # new here
            heapq.heappush(heap, (self.counts[item][0], str(item), item))
        return tuple(self.counts[item])

    def merge(self, other: SpaceSaving) -> SpaceSaving:
        """Both streams' counters: a key that one of them lacks may have had its smallest count there."""
        low = [min((c for c, _ in s.counts.values()), default=0) if len(s.counts) >= s.capacity else 0 for s in (self, other)]
        both = {}
        for k in [*self.counts, *[k for k in other.counts if k not in self.counts]]:
            (a, x), (b, y) = (s.counts.get(k, (m, m)) for s, m in zip((self, other), low, strict=True))
            both[k] = [a + b, x + y]
        top = sorted(both.items(), key=lambda x: (-x[1][0], str(x[0])))[: self.capacity]
        return SpaceSaving(self.capacity, dict(top), self.total + other.total)

    def top(self, n: int) -> list[tuple]:
        return [(k, c, e) for k, (c, e) in sorted(self.counts.items(), key=lambda x: (-x[1][0], str(x[0])))[:n]]

    @property
    def error_bound(self) -> float:
        return self.total / self.capacity


@dataclass
class AlertClusters(Step):
    """Joins an alert to the live cluster of best cosine (the later of equals), else opens one."""

    threshold: float = 0.9
    window_ms: int | None = 60_000
    max_clusters: int = 16_384
    max_tenants: int = 32
    live: list = field(default_factory=list)
    opened: int = 0
    inputs = ("at_ms", "vector", "score", "tenant")
    fields = (("decision", "string"), ("cluster", "long"), ("count", "long"), ("first_seen", "long"), ("last_seen", "long"), ("max_score", "double"), ("tenants", "long"))

    def prune(self, now: int) -> None:
        if self.window_ms is not None:
            self.live = [c for c in self.live if c["last"] >= now - self.window_ms]

    def _matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """Live vectors and their lengths, row by row as in ``live``."""
        held = self.__dict__.get("_held")
        if held is None or held[2] != [c["id"] for c in self.live]:
            rows = [np.asarray(c["vector"], float) for c in self.live]
            held = (np.array(rows) if rows else np.zeros((0, 0)), np.array([c["norm"] for c in self.live]), [c["id"] for c in self.live])
            self._held = held
        return held[0], held[1]

    def update(self, at_ms, vector, score, tenant):
        self.prune(at_ms)
        v = np.asarray(vector, float)
        norm = float(np.linalg.norm(v))
        best, place = -math.inf, None
        if self.live:
            rows, norms = self._matrix()
            both = norms * norm
            cosine = np.where(both > 0, rows @ v / np.where(both > 0, both, 1), 0.0)
            place = len(cosine) - 1 - int(cosine[::-1].argmax())  # the later of equals
            best = float(cosine[place])
        decision = "Joined" if place is not None and best >= self.threshold else "New"
        if decision == "New":
            if len(self.live) >= self.max_clusters:
                del self.live[min(range(len(self.live)), key=lambda k: self.live[k]["last"])]
            self.live.append({"id": self.opened, "vector": v, "norm": norm, "count": 0, "first": at_ms, "last": at_ms, "score": score, "tenants": []})
            self.opened, place = self.opened + 1, len(self.live) - 1
        c = self.live[place]
        c["count"] += 1
        c["first"], c["last"], c["score"] = min(c["first"], at_ms), max(c["last"], at_ms), max(c["score"], score)
        if tenant is not None and tenant not in c["tenants"]:
            c["tenants"] = [*c["tenants"], tenant][-self.max_tenants :]
        return decision, c["id"], c["count"], c["first"], c["last"], c["score"], len(c["tenants"])


def canonical_record(record: str) -> bytes:
    """Canonical bytes of a JSON record: sorted keys, no spaces."""
    return json.dumps(json.loads(record), sort_keys=True, separators=(",", ":")).encode()


def chain_tag(key: bytes, seq: int, previous: bytes, record: str) -> bytes:
    return hmac.new(key, seq.to_bytes(8, "little") + previous + canonical_record(record), hashlib.sha256).digest()


@dataclass
class AuditChain(Step):
    """Appends records to a keyed chain of HMAC-SHA256 tags."""

    key: bytes = b""
    seq: int = 0
    previous: bytes = bytes(32)
    inputs = ("record",)
    fields = (("seq", "long"), ("prev_tag", "binary"), ("tag", "binary"))

    def __post_init__(self):
        if len(self.key) < 32:
            raise ValueError("a key of 32 bytes at least")

    def update(self, record):
        seq, before = self.seq, self.previous
        self.previous, self.seq = chain_tag(self.key, seq, before, record), seq + 1
        return seq, before, self.previous


@dataclass
class PlattOnline(Step):
    """One stochastic gradient step per labelled score."""

    a: float = -1.0
    b: float = 0.0
    rate: float = 0.01
    inputs = ("score", "label")
    fields = (("a", "double"), ("b", "double"))

    def update(self, score, label):
        if _finite(score) and label is not None:
            p = 1 / (1 + math.exp(min(700.0, max(-700.0, self.a * score + self.b))))
            error = (1.0 if label else 0.0) - p
            self.a -= self.rate * error * score
            self.b -= self.rate * error
        return self.a, self.b


@dataclass
class Percentile(Step):
    """Running exact percentile of a short stream; for tests of the digest."""

    q: float = 0.5
    values: list = field(default_factory=list)
    fields = (("percentile", "double"),)

    def update(self, value):
        if _finite(value):
            insort(self.values, value)
        return (float(np.quantile(self.values, self.q)) if self.values else None,)
