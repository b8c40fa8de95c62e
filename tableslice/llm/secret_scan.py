"""Secrets in texts: fixed rules, and a character convolutional network over every other candidate."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import _descend, _sigmoid

#: The rules, with letters of the keyword in either case, and the least length of a finding.
ASSIGN = re.compile(
    rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "model")

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[list((string.ascii_letters + string.digits + "+/_=-.").encode())] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(string.digits.encode())] = True
#: A candidate has this many characters at least, one of them a digit.
CANDIDATE = 16

#: Bytes the network sees before a candidate, of it, and after its last seen byte.
BEFORE, INSIDE, AFTER = 24, 48, 8
WINDOW = BEFORE + INSIDE + AFTER
#: Invented windows that a network learns from besides those of the documents.
SAMPLE = 3000
#: Bytes of text looked at together.
TOGETHER = 8 << 20


def _runs(inside: np.ndarray, borders: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least``; ``borders`` are the texts' starts and the end of all."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[borders] = True
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    starts = np.flatnonzero(after & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~after))
    long = ends - starts >= least
    return starts[long], ends[long]


def scan(texts: list[bytes]) -> tuple[list[list[tuple[int, int, str]]], list[list[tuple[int, int]]]]:
    """Rule findings ``(start, end, kind)`` and other candidates ``(start, end)`` of each text, in bytes."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    borders = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    others: list[list[tuple[int, int]]] = [[] for _ in texts]

    def spread(starts, ends, to, *kind):
        owner = np.searchsorted(borders, starts, "right") - 1
        for i, s, e in zip(owner.tolist(), (starts - borders[owner]).tolist(), (ends - borders[owner]).tolist()):
            to[i].append((s, e, *kind))

    spread(*_runs(_HEX[data], borders, LEAST["hex"]), found, "hex")
    for i, text in enumerate(texts):
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found[i] += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
        if b"AKIA" in text:
            found[i] += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
        found[i].sort(key=lambda f: (f[0], KINDS.index(f[2])))
    starts, ends = _runs(_TOKEN[data], borders, CANDIDATE)
    digits = np.append(0, np.cumsum(_DIGIT[data]))
    some = digits[ends] > digits[starts]
    spread(starts[some], ends[some], others)
    for i, spans in enumerate(others):
        if found[i] and spans:
            others[i] = [c for c in spans if not any(s < c[1] and c[0] < e for s, e, _ in found[i])]
    return found, others


def window(text: bytes, start: int, end: int) -> bytes:
    """What the network sees: context, up to ``INSIDE`` bytes of a candidate, context; zeros beside the text."""
    shown = min(end, start + INSIDE)
    left, right = text[max(0, start - BEFORE): start], text[end: end + AFTER]
    return (left.rjust(BEFORE, b"\0") + text[start:shown].ljust(INSIDE, b"\1") + right.ljust(AFTER, b"\0"))


def windows_of(text: bytes, start: int, end: int) -> list[bytes]:
    """Windows over a whole candidate: a long one is seen in parts that overlap by half."""
    if end - start <= INSIDE:
        return [window(text, start, end)]
    last = end - INSIDE
    return [window(text, a, a + INSIDE) for a in [*range(start, last, INSIDE // 2), last]]


# --- the network ---------------------------------------------------------------

_CODES = 100  # 95 printable characters, blanks, other bytes, and the two paddings
_CODE = np.full(256, 96, np.int64)
_CODE[32:127] = np.arange(95)
_CODE[[9, 10, 13]] = 95
_CODE[0], _CODE[1] = 97, 98
WIDTH, CHANNELS, FILTERS = 5, 8, 24


@dataclass
class Network:
    """Embedded characters, one convolution, the strongest response inside and before the candidate, one layer."""

    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    #: Share of the held findings at the threshold or above.
    recall: float = 0.0

    def _forward(self, codes: np.ndarray):
        x = self.embed[codes]
        cols = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).reshape(len(x), WINDOW - WIDTH + 1, -1)
        h = np.maximum(cols @ self.kernel + self.shift, 0)
        first, second = h[:, : BEFORE - WIDTH + 1], h[:, BEFORE - WIDTH + 1:]
        pooled = np.concatenate((first.max(axis=1), second.max(axis=1), second.mean(axis=1)), axis=1)
        return cols, h, pooled, pooled @ self.out + self.bias

    def logits(self, windows: list[bytes]) -> np.ndarray:
        parts = []
        for at in range(0, len(windows), 512):
            codes = _CODE[np.frombuffer(b"".join(windows[at: at + 512]), np.uint8).reshape(-1, WINDOW)]
            parts.append(self._forward(codes)[3])
        return np.concatenate(parts) if parts else np.zeros(0)

    def chances(self, windows: list[bytes]) -> np.ndarray:
        return _sigmoid(self.slope * self.logits(windows) + self.offset)


_WEIGHTS = ("embed", "kernel", "shift", "out", "bias")


def _begin(seed: int) -> Network:
    rng = np.random.default_rng(seed)
    return Network(
        rng.normal(0, 0.5, (_CODES, CHANNELS)), rng.normal(0, (2 / WIDTH / CHANNELS) ** 0.5, (WIDTH * CHANNELS, FILTERS)),
        np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS), 0.0)


def _pack(values: dict) -> np.ndarray:
    return np.concatenate([np.ravel(values[k]) for k in _WEIGHTS])


def _unpack(net: Network, flat: np.ndarray) -> dict:
    out, at = {}, 0
    for k in _WEIGHTS:
        shape = np.shape(getattr(net, k))
        size = int(np.prod(shape))
        out[k] = flat[at: at + size].reshape(shape) if shape else float(flat[at])
        at += size
    return out


def _pass(net: Network, m: dict, v: dict, step: float, codes: np.ndarray, labels: np.ndarray, rng) -> float:
    """One pass of Adam over the windows, in parts of 128; ``net``, ``m`` and ``v`` are changed."""
    use, cut_at = rng.permutation(len(codes)), BEFORE - WIDTH + 1
    for at in range(0, len(use), 128):
        rows = use[at: at + 128]
        c, y = codes[rows], labels[rows]
        cols, h, pooled, z = net._forward(c)
        d = (_sigmoid(z) - y) / len(rows)
        grad = {"out": pooled.T @ d + 1e-4 * net.out, "bias": d.sum()}
        dp = d[:, None] * net.out
        dh = np.zeros_like(h)
        n, f = np.ogrid[: len(rows), :FILTERS]
        dh[n, h[:, :cut_at].argmax(axis=1), f] = dp[:, :FILTERS]
        dh[n, cut_at + h[:, cut_at:].argmax(axis=1), f] += dp[:, FILTERS: 2 * FILTERS]
        dh[:, cut_at:] += dp[:, None, 2 * FILTERS:] / (h.shape[1] - cut_at)
        dh *= h > 0
        flat = cols.reshape(-1, cols.shape[2])
        grad["kernel"] = flat.T @ dh.reshape(-1, FILTERS)
        grad["shift"] = dh.sum(axis=(0, 1))
        # cols holds channel by place in the window, as the sliding view lays them out
        dc = (dh @ net.kernel.T).reshape(len(rows), -1, CHANNELS, WIDTH)
        grad["embed"] = np.zeros_like(net.embed)
        for w in range(WIDTH):
            np.add.at(grad["embed"], c[:, w: w + dc.shape[1]], dc[..., w])
        step += 1
        for k in _WEIGHTS:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            change = 0.01 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
            setattr(net, k, getattr(net, k) - change)
    return step


def _codes_of(windows: list[bytes]) -> np.ndarray:
    return _CODE[np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW)]


def fit(windows: list[bytes], labels: np.ndarray, recall: float = 0.98, least: float = 0.9, seed: int = 5,
        rounds: int = 8) -> Network:
    """A network for the windows given, here: trained on four fifths, calibrated and its threshold chosen on the rest.

    The logit is calibrated by a logistic fit (Platt).  The threshold is the
    largest that keeps ``recall`` of the held findings, but not below ``least``,
    so that other documents are left alone; ``Network.recall`` says what it keeps.
    ``train`` does the same over tables of any size.
    """
    rng = np.random.default_rng(seed)
    codes = _codes_of(windows)
    order = rng.permutation(len(codes))
    held, use = order[: len(order) // 5], order[len(order) // 5:]
    net = _begin(seed)
    m, v = dict.fromkeys(_WEIGHTS, 0.0), dict.fromkeys(_WEIGHTS, 0.0)
    step = 0
    for _ in range(rounds):
        step = _pass(net, m, v, step, codes[use], labels[use], rng)
    z, y = net.logits([windows[i] for i in held]), labels[held]
    if 0 < y.sum() < len(y):
        pos, neg = z[y == 1, None], z[y == 0, None]
        w = _descend(pos, neg, lambda a, b: (-_sigmoid(-a) / len(y), _sigmoid(b) / len(y)), 1e-3, 500, 0.05)
        net.slope, net.offset = float(w[0]), float(w[1])
        chances = _sigmoid(net.slope * pos[:, 0] + net.offset)
        net.threshold = max(least, float(np.quantile(chances, 1 - recall)))
        net.recall = float((chances >= net.threshold).mean())
    return net


def made_findings(n: int, seed: int = 3) -> tuple[list[bytes], list[int]]:
    """Invented windows with known labels: keys and tokens of common shapes; numbers, names, paths and words."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    letters, mixed = string.ascii_lowercase, string.ascii_letters + string.digits
    word = lambda: pick(letters, int(rng.integers(2, 9)))
    good = [
        lambda: pick("0123456789abcdef", int(rng.integers(32, 65))), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + pick(mixed, 36), lambda: "sk_live_" + pick(mixed, 24), lambda: pick(mixed + "+/", 40),
        lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(mixed, 24), lambda: "eyJ" + pick(mixed, 30) + "." + pick(mixed, 40),
    ]
    bad = [
        lambda: pick(string.digits, 16), lambda: pick(string.digits, int(rng.integers(16, 20))),
        lambda: f"mail{rng.integers(10)}.example.com", lambda: "-".join(word() for _ in range(4)) + pick(string.digits, 2),
        lambda: f"2{pick(string.digits, 3)}-0{pick(string.digits[1:], 1)}-1{pick(string.digits, 1)}T{pick(string.digits, 2)}-30-00",
        lambda: "/".join(word() for _ in range(4)) + "/page" + pick(string.digits, 1), lambda: word() + word() + word() + pick(string.digits, 1),
        lambda: "_".join(word() for _ in range(4)) + "_v" + pick(string.digits, 1), lambda: pick(string.digits, 8) + "-" + pick(string.digits, 8),
    ]
    windows, labels = [], []
    for i in range(n):
        kinds = good if i % 2 else bad
        token = kinds[int(rng.integers(len(kinds)))]()
        before = " ".join(word() for _ in range(5)) + str(rng.choice([" ", " = ", ": ", "=", " \"", " "]))
        text = f"{before}{token} {word()} {word()}".encode()
        windows.append(window(text, len(before), len(before) + len(token)))
        labels.append(i % 2)
    return windows, labels


def _texts(batch):
    """Texts of a batch in parts of about ``TOGETHER`` bytes."""
    part, size, begin = [], 0, 0
    for i, t in enumerate(batch.column(1).cast(pa.binary())):
        part.append(t.as_py() or b"")
        size += len(part[-1])
        if size >= TOGETHER:
            yield begin, part
            part, size, begin = [], 0, i + 1
    if part:
        yield begin, part


def _select(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Windows that a task goes through by itself between two means of the weights.
TOGETHER_WINDOWS = 4096
#: Passes over all windows, and steps of the calibration.
PASSES, CALIBRATION = 12, 12
#: Sums over tasks are of whole multiples of this, so that they come out alike in any order.
GRAIN = 2.0 ** -30


def _sums(rows: DataFrame, make) -> np.ndarray:
    """The sum, place by place, of the arrays that ``make`` gives for each batch of ``rows``' chunks."""
    def run(batches):
        total = None
        for batch in batches:
            for one in batch.to_pylist():
                got = np.rint(make(one) / GRAIN).astype(np.int64)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

    got = rows.mapInArrow(run, "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toArrow()
    return got.column("x").to_numpy() * GRAIN


def train(docs: DataFrame, invented: int = SAMPLE, recall: float = 0.98, least: float = 0.9, seed: int = 5) -> Network:
    """A network from all findings of the rules, all other candidates and ``invented`` windows of known kind.

    The distinct windows of all documents take part; of a long finding its
    first, of another long candidate all.  Half of the findings, by a hash, come
    without their context as well, so that shape counts.  A fifth, by a hash, is held for
    calibration and the threshold.  The windows lie in chunks by a hash; in each
    pass every chunk goes on from the same weights by itself, and the mean of
    theirs, by their windows, begins the next.  Calibration (Platt) and threshold
    come from sums over all held windows.  The driver holds weights and sums only.
    """
    from ..session import cut

    def run(batches):
        for batch in batches:
            out: list[tuple[bytes, int]] = []
            for _, part in _texts(batch):
                for text, found, others in zip(part, *scan(part)):
                    out += [(window(text, s, e), 1) for s, e, _ in found]
                    out += [(w, 0) for s, e in others for w in windows_of(text, s, e)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in out], pa.binary()), pa.array([y for _, y in out], pa.int32())], names=["w", "y"])

    spark = docs.sparkSession
    seen = cut(_select(docs).mapInArrow(run, "w binary, y int").groupBy("w").agg(F.max("y").alias("y")))
    bare = seen.filter((F.col("y") == 1) & (F.pmod(F.xxhash64("w", F.lit("bare")), F.lit(2)) == 0)).select(
        F.concat(F.lit(b"\0" * BEFORE), F.substring("w", BEFORE + 1, WINDOW)).alias("w"), "y")
    made = spark.createDataFrame([(bytearray(w), y) for w, y in zip(*made_findings(invented))], "w binary, y int")
    every = cut(seen.unionByName(bare).unionByName(made).withColumn(
        "held", F.pmod(F.xxhash64("w", F.lit("held")), F.lit(5)) == 0))
    n = max(1, every.count() // TOGETHER_WINDOWS)
    chunks = cut(
        every.groupBy("held", F.pmod(F.xxhash64("w", F.lit("chunk")), F.lit(n)).alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("w", "y"))).alias("rows"))
        .select("held", "chunk", F.transform("rows", lambda r: r["w"]).alias("w"), F.transform("rows", lambda r: r["y"]).alias("y")))
    use, held = chunks.filter("NOT held").select("chunk", "w", "y"), chunks.filter("held").select("chunk", "w", "y")
    net = _begin(seed)
    m, v = (_unpack(net, np.zeros(len(_pack(vars(net))))) for _ in range(2))
    step = 0.0
    for turn in range(PASSES):
        begin, first, second = _pack(vars(net)), _pack(m), _pack(v)

        def go_on(one, turn=turn, begin=begin, first=first, second=second, step=step):
            own = _begin(seed)
            for k, x in _unpack(own, begin.copy()).items():
                setattr(own, k, x)
            a, b = _unpack(own, first.copy()), _unpack(own, second.copy())
            after = _pass(own, a, b, step, _codes_of(one["w"]), np.array(one["y"], float), np.random.default_rng([turn, one["chunk"]]))
            return len(one["y"]) * np.concatenate((_pack(vars(own)), _pack(a), _pack(b) / GRAIN ** 0.5, [after, 1.0]))

        total = _sums(use, go_on)
        if not len(total):
            return net
        mean = total[:-1] / total[-1]
        for k, x in _unpack(net, mean[: len(begin)]).items():
            setattr(net, k, x)
        m = _unpack(net, mean[len(begin): 2 * len(begin)])
        v = _unpack(net, mean[2 * len(begin): -1] * GRAIN ** 0.5)
        step = mean[-1]
    return _calibrated(net, cut(_logits(held, net)), recall, least)


def _logits(held: DataFrame, net: Network) -> DataFrame:
    def run(batches):
        for batch in batches:
            for one in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(net.logits(one["w"])), pa.array(one["y"], pa.int32())], names=["z", "y"])

    return held.mapInArrow(run, "z double, y int")


def _calibrated(net: Network, scored: DataFrame, recall: float, least: float) -> Network:
    """Slope and offset by Newton's steps over all ``z, y``; the threshold by counts in ever finer bins."""
    found = scored.filter("y = 1")
    n, n_found = scored.count(), found.count()
    if not 0 < n_found < n:
        return net
    w = np.zeros(2)
    for _ in range(CALIBRATION):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("z") * float(w[0]) + float(w[1])))))
        part = [p - F.col("y"), (p - F.col("y")) * F.col("z"), p * (1 - p), p * (1 - p) * F.col("z"), p * (1 - p) * F.col("z") * F.col("z")]
        g0, g1, h0, h1, h2 = (float(x) / n for x in scored.agg(*[F.sum(x.cast("decimal(38,15)")) for x in part]).first())
        grad, curve = np.array([g1 + 1e-3 * w[0], g0]), np.array([[h2 + 1e-3, h1], [h1, h0 + 1e-6]])
        move = np.linalg.solve(curve, grad)
        w = w - move * min(1.0, 2.0 / float(np.abs(move).max() + 1e-12))
    net.slope, net.offset = float(w[0]), float(w[1])
    chance = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("z") * net.slope + net.offset))))
    chances = found.select(chance.alias("p"))
    below, low, width = int((1 - recall) * (n_found - 1)), 0.0, 1.0
    for _ in range(3):  # where the finding with so many below it is
        width /= 1000
        at = F.least(F.floor((F.col("p") - low) / width), F.lit(999)).cast("int")
        bins = {r["at"]: r["count"] for r in chances.filter((F.col("p") >= low) & (F.col("p") <= low + 1000 * width))
                .groupBy(at.alias("at")).count().collect()}
        under = chances.filter(F.col("p") < low).count()
        for k in sorted(bins):
            under += bins[k]
            if under > below:
                low += k * width
                break
    net.threshold = max(least, low)
    net.recall = chances.filter(F.col("p") >= net.threshold).count() / n_found
    return net


def find_secrets(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id, spans`` per row of ``docs``; a span is ``kind, start, end`` in code points, end exclusive.

    ``assign``, ``access`` and ``hex`` are all findings of the rules; ``model``
    are other candidates (runs of key characters with a digit) whose chance is
    at the network's threshold or above.  Spans are sorted by start, then kind
    in that order.  A null or empty text has none; rows are looked at alone, so
    repeated rows and null ids give their own; other columns are ignored.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for _, part in _texts(batch):
                found, others = scan(part)
                flat = [(i, s, e) for i, spans in enumerate(others) for s, e in spans]
                seen = [windows_of(part[i], s, e) for i, s, e in flat]
                chance = network.chances([w for ws in seen for w in ws])
                at = np.cumsum([0, *map(len, seen)])
                for (i, s, e), a, b in zip(flat, at, at[1:]):
                    if chance[a:b].max() >= network.threshold:  # the likeliest part counts
                        found[i].append((s, e, "model"))
                for text, spans in zip(part, found):
                    if spans:
                        point = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
                        spans = sorted(spans, key=lambda f: (f[0], KINDS.index(f[2])))
                        spans = [{"kind": k, "start": int(point[s]), "end": int(point[e])} for s, e, k in spans]
                    rows.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], names=["doc_id", "spans"])

    return _select(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_digests(docs: DataFrame, invented: int = SAMPLE) -> DataFrame:
    """Counts of the rules' findings, a checksum of them, and all spans as text."""
    spans = find_secrets(docs, train(docs, invented))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "model")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"))
