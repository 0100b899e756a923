"""Personal data: high-recall span proposals, chosen by gradient-boosted trees.

Four kinds of fixed form (email, ip, card, phone) are always found. Generators propose further
spans, which may overlap: secrets, account and identity numbers, spelled-out addresses. Boosted
trees score each proposal by its format and its surroundings; a threshold for each kind, set on
the proposals of all documents that were kept from the fit, chooses the spans; of overlapping ones
the best score stays. No labels are given: they come from keywords before a span and made lines.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.common import byte_set, ids_of, map_arrow, slices, utf8, written

Span = tuple[str, int, int]

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "ssn", "iban", "spelled_email", "number")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits and what numbers are written with; matches of ip and card never leave such a run.
_ZONE = re.compile(r"[0-9][0-9 .()\-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_LONG_TOKEN = re.compile(r"[A-Za-z0-9_\-]{16,}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?<![0-9])[0-9](?:[ .()-]{0,2}[0-9]){6,}")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)
_AT = re.compile(r"[\[(]at[\])]", re.I)
_KEYWORDS = (
    re.compile(r"token|key|secret|passw|pwd|auth|bearer|credential", re.I),
    re.compile(r"ssn|social security|passport|tax id|identity", re.I),
    re.compile(r"iban|account|konto|cuenta|compte|card|carte|karte|tarjeta", re.I),
    re.compile(r"phone|\btel(?:efon\w*)?\b|mobile|\bcall\b|\bfax\b", re.I),
    re.compile(r"mail", re.I),
)
#: Characters before and after a span that count as its surroundings.
CONTEXT = 24


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield "email", start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """The spans of fixed form, by kind and start."""
    out: dict[str, list[Span]] = {k: [] for k in BASE_KINDS}
    out["email"] = list(_emails(text))
    for zone in _ZONE.finditer(text):
        if zone.end() - zone.start() < 7:
            continue
        for m in _IP.finditer(text, zone.start(), zone.end()):
            if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m.group().split(".")):
                out["ip"].append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text, zone.start(), zone.end()):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out["phone"].append(("phone", m.start(), m.end()))
    return [s for k in BASE_KINDS for s in out[k]]


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data, with high recall; they may overlap."""
    out = [("spelled_email", m.start(), m.end()) for m in _SPELLED.finditer(text)] if _AT.search(text) else []
    if _ZONE.search(text):
        for m in _LONG_TOKEN.finditer(text):
            run = m.group()
            if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
                out.append(("secret", m.start(), m.end()))
        for kind, pattern in (("ssn", _SSN), ("iban", _IBAN), ("number", _NUMBER)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and surroundings of a span."""
    kind, start, end = span
    value = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    n = len(value)
    digits = [c for c in value if "0" <= c <= "9"]
    runs = [len(r) for r in re.findall(r"[0-9]+", value)]
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))
    return [
        float(ADDED_KINDS.index(kind)),
        float(n),
        len(digits) / n,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        sum(c.isupper() for c in value) / n,
        len(set(value)) / n,
        turns / n,
        float(len(runs)),
        float(max(runs, default=0)),
        float(len(digits) >= 12 and luhn("".join(digits))),
        *(float(bool(k.search(before))) for k in _KEYWORDS),
        float(before[-1:] in ('"', "'", "=", ":")),
        float("=" in before[-4:] or ":" in before[-4:]),
        float(after[:1] in ('"', "'")),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
    ]


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit; finding and choosing spans have none.

    documents: documents of the sample, those of the smallest hash of their id.
    spans_per_document: proposals that each of these gives to the fit, of every kind in turn.
    Thresholds are set on the proposals of all documents, without those that the trees were fitted to.
    """

    documents: int = 2000
    spans_per_document: int = 20
    examples: int = 1200
    trees: int = 12
    depth: int = 3
    precision: float = 0.98


@dataclass(frozen=True)
class Model:
    """Trees as arrays (feature or -1, threshold, left, right, value) and thresholds by kind."""

    trees: tuple[tuple[np.ndarray, ...], ...]
    weights: tuple[float, ...]
    thresholds: dict[str, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row, as boosted trees give it for the log-loss."""
        margin = np.zeros(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            node = np.zeros(len(x), int)
            while (inner := feature[node] >= 0).any():
                goes_left = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= threshold[node]
                node = np.where(inner, np.where(goes_left, left[node], right[node]), node)
            margin += weight * value[node]
        return 1 / (1 + np.exp(-2 * margin))

    def choose(self, text: str, base: list[Span]) -> list[Span]:
        """The added spans of a text, by kind and start."""
        found = proposals(text)
        if not found:
            return []
        scores = self.scores(np.array([features(text, s) for s in found]))
        taken = sorted((a, b) for _, a, b in base)
        good = [  # scores that differ little count as equal; then the more specific kind goes first
            (-round(float(p), 1), ADDED_KINDS.index(s[0]), s[1], s) for p, s in zip(scores, found) if p >= self.thresholds.get(s[0], 2.0)
        ]
        out: list[Span] = []
        ends = np.array([b for _, b in taken], int)
        starts = np.array([a for a, _ in taken], int)
        reach = np.maximum.accumulate(ends) if len(ends) else ends
        chosen: list[tuple[int, int]] = []
        for _, _, _, (kind, a, b) in sorted(good):
            k = int(np.searchsorted(starts, b)) - 1
            if k >= 0 and reach[k] > a:
                continue
            i = bisect.bisect_left(chosen, (a, b))
            if (i and chosen[i - 1][1] > a) or (i < len(chosen) and chosen[i][0] < b):
                continue
            chosen.insert(i, (a, b))
            out.append((kind, a, b))
        return sorted(out, key=lambda s: (ADDED_KINDS.index(s[0]), s[1]))


def examples(n: int) -> list[tuple[str, str, int]]:
    """Labelled lines made by rule: (text, kind, whether the span of that kind is personal data)."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(("an", "re", "tion", "lo", "me", "st", "er", "vi")) for _ in range(rng.randint(1, 4)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    makers = (
        lambda: (rng.choice(("token", "api_key", "secret", "password", "auth token", "access key")) + rng.choice((' = "{}"', ": {}", "={}", " = '{}'", ' "{}"')).format(rng.choice((hexes, mixed))(rng.choice((20, 24, 32, 40)))), "secret", 1),
        lambda: (f"{word()}-{word()}-{word()}-{digits(2)}-{word()}", "secret", 0),
        lambda: (f"{word()} {word()}{word()}{word()}{word()}{word()}{digits(rng.randint(1, 3))} {word()}", "secret", 0),
        lambda: (f"{word()} {digits(4)}_{word()}_{word()}_{word()}", "secret", 0),
        lambda: (f"{rng.choice(('SSN', 'ssn:', 'social security number', 'tax id'))} {digits(3)}-{digits(2)}-{digits(4)}", "ssn", 1),
        lambda: (f"{rng.choice(('part', 'item', 'lot', 'version', 'order'))} {digits(3)}-{digits(2)}-{digits(4)} {word()}", "ssn", 0),
        lambda: (f"{rng.choice(('IBAN', 'account', 'Konto', 'cuenta'))} {rng.choice(('DE', 'FR', 'ES', 'GB'))}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)}", "iban", 1),
        lambda: (f"{word()} {rng.choice(('AB', 'XQ', 'ZZ'))}{digits(2)}{digits(4)}{digits(4)} {word()}", "iban", 0),
        lambda: (f"{word()}.{word()} [at] {word()}{word()} [dot] {rng.choice(('com', 'org', 'net'))}", "spelled_email", 1),
        lambda: (f"{word()} (at) {word()}.{word()} {word()}", "spelled_email", 0),
        lambda: (f"{rng.choice(('passport', 'account', 'card number', 'identity'))} {digits(rng.randint(8, 12))}", "number", 1),
        lambda: (f"{word()} {word()} {digits(rng.randint(7, 20))} {word()}", "number", 0),
        lambda: (f"{word()} {digits(4)}.{digits(2)}.{digits(2)} {digits(2)} {word()}", "number", 0),
        lambda: (f"{rng.choice(('Tel.', 'tel', 'Telefon', 'phone:', 'call', 'mobile', 'Fax'))} {rng.choice(('0{} {}', '{} 555 {}', '{}-555-{}', '({}) {}')).format(digits(3), digits(rng.randint(4, 7)))}", "number", 1),
    )
    return [makers[i % len(makers)]() for i in range(n)]


def _rows_of(text: str, most: int) -> list[tuple[str, list[float], float, bool]]:
    """Proposals of a text of the corpus, labelled by what rules can tell, and whether they may be fitted to.

    Personal: a proposal with a keyword of its kind before it. Not: one without any keyword. Of the
    others, with a keyword of another kind, nothing is known. The fit has at most so many proposals
    of a text: those of each kind in the order of a hash, the kinds in turn.
    """
    rows, order = [], []
    seen: dict[str, list[tuple[int, int]]] = {}
    for span in proposals(text):
        x = features(text, span)
        named = x[10:15]
        own = {"secret": named[0], "ssn": named[1], "iban": named[2], "spelled_email": 1.0, "number": max(named[1:4])}[span[0]]
        if own or not any(named):
            seen.setdefault(span[0], []).append((zlib.crc32(f"{span[1]} {text[span[1] : span[2]]}".encode("utf-8", "replace")), len(rows)))
            rows.append((span[0], x, float(own)))
    for kind, found in seen.items():
        order += [(turn, ADDED_KINDS.index(kind), k) for turn, (_, k) in enumerate(sorted(found))]
    fitted = {k for _, _, k in sorted(order)[:most]}
    return [(*row, k in fitted) for k, row in enumerate(rows)]


def _kept(x: list[float]) -> bool:
    """A quarter of the rows is kept from the fit."""
    return zlib.crc32(np.array(x).tobytes()) % 4 == 0


#: Steps of the histogram of scores; a power of two, so that a step and its least score are told apart exactly.
STEPS = 4096


def fit(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit trees to made examples and to a bounded sample of the documents, thresholds to all documents.

    The sample's ids are few enough to be broadcast; its proposals are made where the texts lie.
    Thresholds need counts only: of the labelled proposals by kind, step of their score and label.
    """
    spark: SparkSession = docs.sparkSession
    key = F.xxhash64(F.col("doc_id"), F.lit(4))
    ids = docs.select(F.col(f"`{id_col}`").alias("doc_id")).where("doc_id is not null")
    ids = written(ids.orderBy(key, "doc_id").limit(limits.documents).distinct(), "pii-ids")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    per_doc = limits.spans_per_document

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r[:3] for t in batch.column(0).to_pylist() for r in _rows_of(t or "", per_doc) if r[3] and not _kept(r[1])]
            if out:
                kinds, x, y = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64())], names=["kind", "x", "y"])

    schema = "kind string, x array<double>, y double"
    sample = map_arrow(texts.join(F.broadcast(ids), "doc_id", "left_semi").select("text"), rows, schema)
    made = [(kind, features(text, s), float(y)) for text, kind, y in examples(limits.examples) for s in proposals(text) if s[0] == kind]
    # Bounded by limits.documents * limits.spans_per_document; written once, read by every tree.
    own = spark.createDataFrame([r for r in made if not _kept(r[1])], schema)
    everything = written(sample.unionByName(own), "pii-sample").withColumn("vector", array_to_vector("x"))
    trained = GBTClassifier(
        featuresCol="vector", labelCol="y", maxIter=limits.trees, maxDepth=limits.depth, stepSize=0.3, seed=5
    ).fit(everything)
    trees = tuple(_arrays(t._call_java("rootNode")) for t in trained.trees)
    model = Model(trees, tuple(trained.treeWeights), {})

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sampled = batch.column(0).to_pylist()
            counts: Counter[tuple[str, int, float]] = Counter()
            row = 0
            for text in _marked(batch.column(1)):
                if text:
                    counts.update(_steps(model, [r for r in _rows_of(text, per_doc) if not (sampled[row] and r[3] and not _kept(r[1]))]))
                row += 1
            if counts:
                kinds, steps, y = zip(*counts)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(steps, pa.int32()), pa.array(y, pa.float64()), pa.array(counts.values(), pa.int64())], names=["kind", "step", "y", "n"])

    flagged = texts.join(F.broadcast(ids.withColumn("s", F.lit(True))), "doc_id", "left").select(F.coalesce("s", F.lit(False)).alias("sampled"), "text")
    found = map_arrow(flagged, counted, "kind string, step int, y double, n long").groupBy("kind", "step", "y").agg(F.sum("n").alias("n")).collect()
    counts = Counter({(r["kind"], r["step"], r["y"]): r["n"] for r in found})  # at most kinds * steps * labels
    counts.update(_steps(model, [r for r in made if _kept(r[1])]))
    return Model(trees, model.weights, _calibrated(counts, limits.precision))


def _steps(model: Model, rows: list[tuple]) -> Counter[tuple[str, int, float]]:
    """How many of the rows (kind, x, y) there are by kind, step of the score and label."""
    if not rows:
        return Counter()
    steps = np.minimum(model.scores(np.array([r[1] for r in rows])) * STEPS, STEPS - 1).astype(int)
    return Counter((r[0], int(s), r[2]) for r, s in zip(rows, steps))


def _calibrated(counts: Counter[tuple[str, int, float]], precision: float) -> dict[str, float]:
    """For each kind the lowest step from which on the rows are right often enough."""
    out = {}
    for kind in ADDED_KINDS:
        right, rows = np.zeros(STEPS, np.int64), np.zeros(STEPS, np.int64)
        for (k, step, y), n in counts.items():
            if k == kind:
                rows[step] += n
                right[step] += n * (y > 0)
        if not right.any():
            continue
        above, all_above = np.cumsum(right[::-1])[::-1], np.cumsum(rows[::-1])[::-1]
        good = np.flatnonzero((rows > 0) & (above >= precision * all_above))
        if len(good):
            out[kind] = max(float(good[0]) / STEPS, 0.5)
    return out


def _arrays(root) -> tuple[np.ndarray, ...]:
    """A fitted tree as arrays."""
    nodes: list[list[float]] = []

    def add(node) -> int:
        i = len(nodes)
        nodes.append([-1, 0.0, -1, -1, node.prediction()])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            nodes[i][:2] = [split.featureIndex(), split.threshold()]
            nodes[i][2] = add(node.leftChild())
            nodes[i][3] = add(node.rightChild())
        return i

    add(root)
    f, t, a, b, v = zip(*nodes)
    return np.array(f, int), np.array(t, float), np.array(a, int), np.array(b, int), np.array(v, float)


_MARKS = byte_set(b"0123456789@+[(")


def _marked(column: pa.Array) -> Iterator[str]:
    """The text of each row, empty if it has no mark that any span needs."""
    data, at = utf8(column)
    for low, high in slices(at):
        marks = np.concatenate([[0], np.cumsum(_MARKS[data[at[low] : at[high]]], dtype=np.int64)])
        marked = np.diff(marks[at[low : high + 1] - at[low]]) > 0
        for k in range(low, high):
            yield data[at[k] : at[k + 1]].tobytes().decode("utf-8", "surrogatepass") if marked[k - low] else ""


def _spans_of(batch_column: pa.Array, model: Model) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """(text, base spans, added spans) of each row; texts without any mark are not searched."""
    for text in _marked(batch_column):
        base = base_spans(text) if text else []
        yield text, base, model.choose(text, base) if text else []


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the spans of its whole text.

    spans holds structs of kind, start and end (code points, end exclusive), the base kinds first
    and in their order, each kind by start; n_<kind> counts the base spans. Null and empty texts
    have no spans. Rows are independent: repeated rows give repeated results, a null id stays null,
    an empty table gives an empty result, further columns are ignored. Nothing is shuffled.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {k: [] for k in BASE_KINDS}
            base_hex, spans = [], []
            for _, base, added in _spans_of(batch.column(1), model):
                for k in BASE_KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                base_hex.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base + added])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(base_hex, pa.string()), pa.array(spans, pa.list_(span))],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    return map_arrow(
        ids_of(docs, id_col, text_col),
        run,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
        "spans array<struct<kind: string, start: long, end: long>>",
    )


def digests(found: DataFrame) -> DataFrame:
    """The spans as one text of kind:start:end, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return found.withColumn("spans", F.array_join(F.transform("spans", one), ","))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with the name of its kind, in capitals and brackets, in place of each span.

    Overlapping spans become one, named by the first.
    """
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with personal data of the text replaced and its length counted anew."""
    names, schema = docs.columns, docs.schema
    where = names.index(text_col)
    length = names.index(count_col) if count_col in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[where].to_pylist()
            for k, (text, base, added) in enumerate(_spans_of(columns[where], model)):
                if base or added:
                    texts[k] = redacted(text, base + added)
            columns[where] = pa.array(texts, columns[where].type)
            if length is not None:
                kind = columns[length].type
                counts = zip(columns[length].to_pylist(), texts)
                columns[length] = pa.array([n if t is None else len(t) for n, t in counts], kind)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(docs, run, schema)
