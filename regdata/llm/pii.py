"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds to them.

The patterns give the base spans. Around every digit, ``@`` and ``+`` lies a region of
neighbouring tokens; outside regions no segment is a candidate, so nothing is lost by
looking at regions only. A region is cut into pieces (runs of digits, runs of letters, single
signs), and every run of up to ``LONGEST`` pieces is a candidate segment of every kind.
A segment is scored as a whole, by features of its full text and of what stands next to
it; pieces outside segments score 0. Dynamic programming over the pieces picks boundaries
and kinds of all segments of a region together, in time linear in its length.

Weights are learned by gradient steps on the likelihood of the base spans in a bounded sample
of regions, the smallest by a hash. Each phone number is also learned without its plus sign, so
the field finds numbers that the pattern does not know. Segments found that touch no base
span are added; base spans always stay.

Defined results: a null text is empty and has no spans; positions are code points, ends
exclusive. Without regions nothing is learned and nothing added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdata.llm.arrow import add_columns, column, share_code, text_of
from regdata.llm.few import smallest
from regdata.session import materialise

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that they never look at a run of digits twice.
EMAIL_NAME, EMAIL_HOST = re.compile(r"[A-Za-z0-9._%+-]+\Z"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NAME_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

HINT = re.compile(r"[0-9@+]")
TOKEN_END = re.compile(r"\s|\Z")
PIECE = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
CLUE = {
    "email": re.compile(r"e-?mail|contact", re.I), "ip": re.compile(r"\bip\b|address|server|host", re.I),
    "card": re.compile(r"card|visa|credit", re.I), "phone": re.compile(r"phone|tel|call|fax|mobile", re.I),
}
LONGEST = 24  # pieces of a segment
SAMPLE = 2000  # regions that are learned from
REGION = 400  # characters of a region that is learned from; longer ones are only searched
EPOCHS, RATE, DECAY = 12, 0.3, 1e-4
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and then start."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in NAME_SIGNS:
            start -= 1
        if start < at and (host := EMAIL_HOST.match(text, at + 1)):
            out.append(("email", start, end := host.end()))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p) < 40 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of tokens that hold a hint, one blank apart."""
    start = end = -1
    for m in HINT.finditer(text):
        if m.start() < end:
            continue
        first = m.start()
        while first > max(end, 0) and not text[first - 1].isspace():
            first -= 1
        last = TOKEN_END.search(text, m.end()).start()
        if start >= 0 and (first > end + 1 or first == end):
            yield start, end
            start = -1
        if start < 0:
            start = first
        end = last
    if start >= 0:
        yield start, end


def cut(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PIECE.finditer(text)]


def describe(s: str, before: str, after: str, left: str) -> list[float]:
    """Features of a whole segment."""
    d = digits_of(s)
    n = len(d)
    parts = s.split(".")
    letters = sum(c.isalpha() for c in s)
    signs = set(s) - set("0123456789")
    host = s.rpartition("@")[2]
    return [
        1.0, s.count("@") == 1, "@" in s and "." in host and not host.startswith(".") and host.replace(".", "").replace("-", "").isalnum(),
        "@" in s and s[0] != "@", len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts), len(parts) > 4,
        n < 7, 7 <= n <= 8, 9 <= n <= 12, 13 <= n <= 15, 16 <= n <= 19, n > 19, 13 <= n <= 19 and luhn(d), n == len(s),
        signs <= set(" -"), signs <= set(" -().+"), s[0] == "+", "(" in s and ")" in s, s.count("-") + s.count(" ") + s.count(".") >= 2,
        letters > 0, letters > 0 and "@" not in s, before.isalnum(), before != "" and before in "._%+-@", after.isalnum(), after != "" and after in "-@",
        *[bool(c.search(left)) for c in CLUE.values()],
    ]


def segments(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """Pieces of a region, candidate segments as pairs of pieces, and their features."""
    pieces = [(a + start, b + start) for a, b in cut(text[start:end])]
    pairs, rows = [], []
    left = text[max(0, start - 24) : start]
    for i, (a, _) in enumerate(pieces):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        for j in range(i, min(len(pieces), i + LONGEST)):
            b = pieces[j][1]
            if text[b - 1].isalnum():
                pairs.append((i, j + 1))
                rows.append(describe(text[a:b], text[max(0, a - 1) : a], text[b : b + 1], left))
    return pieces, pairs, np.array(rows, dtype=np.float64).reshape(len(rows), -1)


def logsum(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(sum(np.exp(v - top) for v in values)))


def expected(n: int, pairs: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of every segment and kind, by the forward and backward sums."""
    ends, starts = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    whole = np.logaddexp.reduce(scores, axis=1)
    for k, (i, j) in enumerate(pairs):
        ends[j].append((i, k))
        starts[i].append((j, k))
    ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = logsum([ahead[j - 1], *[ahead[i] + whole[k] for i, k in ends[j]]])
    for i in range(n - 1, -1, -1):
        back[i] = logsum([back[i + 1], *[back[j] + whole[k] for j, k in starts[i]]])
    around = np.array([ahead[i] + back[j] for i, j in pairs]) - ahead[n]
    return np.exp(scores + around[:, None])


def best(n: int, pairs: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
    """Segments (first piece, last piece, kind) of the best cut of a region."""
    ends = [[] for _ in range(n + 1)]
    kind, top = scores.argmax(axis=1), scores.max(axis=1)
    for k, (i, j) in enumerate(pairs):
        ends[j].append((i, k))
    value, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for i, k in ends[j]:
            if value[i] + top[k] > value[j]:
                value[j], back[j] = value[i] + top[k], k
    out, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            i, stop = pairs[back[j]]
            out.append((i, stop, int(kind[back[j]])))
            j = i
    return out[::-1]


Example = tuple[str, int, int, list[Span]]


def learn(examples: list[Example]) -> np.ndarray | None:
    """Weights (kinds x features) from regions with their spans; None without examples."""
    ready = []
    for text, start, end, spans in examples:
        pieces, pairs, rows = segments(text, start, end)
        if not pairs:
            continue
        gold = np.zeros((len(pairs), len(KINDS)))
        where = {(pieces[i][0], pieces[j - 1][1]): k for k, (i, j) in enumerate(pairs)}
        taken = 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= taken and (a, b) in where:
                gold[where[a, b], KINDS.index(kind)], taken = 1, b
        ready.append((len(pieces), pairs, rows, gold))
    if not ready:
        return None
    weights = np.zeros((len(KINDS), ready[0][2].shape[1]))
    weights[:, 0] = -2
    rng = np.random.Generator(np.random.Philox(key=7))
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(ready)):
            n, pairs, rows, gold = ready[i]
            gradient = (expected(n, pairs, rows @ weights.T) - gold).T @ rows
            weights -= RATE / (1 + epoch) * (gradient + DECAY * weights)
    return weights


def extra_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """Segments of the field that touch no base span."""
    out = []
    for start, end in regions(text):
        pieces, pairs, rows = segments(text, start, end)
        if pairs:
            out += [(KINDS[k], pieces[i][0], pieces[j - 1][1]) for i, j, k in best(len(pieces), pairs, rows @ weights.T)]
    if out and base:
        starts = np.array(sorted((a, b) for _, a, b in base))
        reach = np.maximum.accumulate(starts[:, 1])
        before = np.searchsorted(starts[:, 0], [b for _, _, b in out])  # base spans that begin before the end
        out = [s for s, k in zip(out, before) if k == 0 or reach[k - 1] <= s[1]]
    return out


def examples(text: str) -> Iterator[Example]:
    """Regions in what surrounds them, with base spans; phone numbers once more without their sign."""
    base = base_spans(text)
    for start, end in regions(text):
        if end - start > REGION:
            continue
        left = max(0, start - 24)
        part = text[left : end + 1]
        spans = [(k, a - left, b - left) for k, a, b in base if a >= start and b <= end]
        yield part, start - left, end - left, spans
        if len(spans) == 1 and spans[0][0] == "phone":
            _, a, b = spans[0]
            yield part[:a] + part[a + 1 :], start - left, end - left - 1, [("phone", a, b - 1)]


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> np.ndarray | None:
    """Learn from at most ``sample`` regions, each of at most ``REGION`` characters."""
    short = docs.select(F.col(text).alias("_t")).where(F.col("_t").rlike("[0-9@+]"))

    def run(batches):
        for batch in batches:
            found = [e for t in column(batch, "_t") for e in examples(text_of(t))]
            spans = [[dict(zip(("kind", "a", "b"), s)) for s in own] for *_, own in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))
            columns = [pa.array([e[i] for e in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], ["part", "start", "end", "spans"])

    share_code(docs.sparkSession)
    found = short.mapInArrow(run, "part string, start int, end int, spans array<struct<kind string, a int, b int>>")
    found = materialise(found.withColumn("_order", F.xxhash64("part")))  # short parts of few documents
    picked = smallest(found, "_order", ["part", "start", "end", "spans"], sample).collect()
    return learn([(r.part, r.start, r.end, sorted((s.kind, s.a, s.b) for s in r.spans)) for r in picked])


def find(docs: DataFrame, weights: np.ndarray | None, text: str = "text") -> DataFrame:
    """Add ``base`` and ``spans``, arrays of (kind, start, end) by kind and start."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        base, spans = [], []
        for cell in column(batch, text):
            t = text_of(cell)
            own = base_spans(t) if HINT.search(t) else []
            more = extra_spans(t, own, shared.value) if shared.value is not None and HINT.search(t) else []
            every = sorted([*own, *more], key=lambda s: (KINDS.index(s[0]), s[1]))
            base.append([dict(zip(("kind", "start", "end"), s)) for s in own])
            spans.append([dict(zip(("kind", "start", "end"), s)) for s in every])
        return [pa.array(base, kind), pa.array(spans, kind)]

    return add_columns(docs, make, [("base", schema), ("spans", schema)])
