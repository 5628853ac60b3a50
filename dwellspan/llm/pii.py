"""Personal data: patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole segments of tokens: digit counts, checksums, shapes, separators, brackets and
neighbours are features of a candidate span, not of single tokens. Dynamic programming over segments of
bounded length chooses boundaries and types jointly. Its weights maximise the conditional likelihood of
generated lines of which every span is known (numpy, fixed seed); no corpus row trains it.

Only stretches that can hold an entity (an address sign or enough digits close together) are decoded;
stretches are found over whole texts.

Edge cases: a null text is an empty one and has no spans. Repeated rows are independent. An empty
table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import bisect
import itertools
import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .secrets import SPAN_TYPE, SPANS, digest_columns, span_rows

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
LONGEST = 15  # tokens of an entity
CONTEXT = 3  # tokens around a stretch

#: The contract's patterns, with runs taken possessively where nothing can be given back.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Superset filter for the column kernel (RE2).
FILTER = r"@|(?i:[\[(]at[\])])|[0-9][0-9 ().+/-]{5,}[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans (kind, start, end) in code points, leftmost and non-overlapping by kind."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > free and text[a - 1] in EMAIL_LOCAL:
            a -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", at + 1)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x[-9:]) <= 255 and len(x.lstrip("0")) < 4 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


# Candidate segments and their features

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]", re.UNICODE)
BREAK = re.compile(r"[\s@]")
AT = re.compile(r"[\[(][aA][tT][\])]")
SPELLED = re.compile(r"\S+ ?[\[(][aA][tT][\])] ?\S+(?: ?[\[(][dD][oO][tT][\])] ?\S+)*")
NUMBERS = re.compile(r"(?:[+(]{0,2}[0-9][0-9().+/-]*[ ]?)*[+(]{0,2}[0-9][0-9().+/-]*")
MOST_CHARACTERS = 400  # of a segment of several tokens
STEP = 512  # tokens whose candidates are held at a time


def _run_start(text: str, at: int, free: int, stop: str) -> int:
    """Where the run of characters that are neither blank nor ``stop`` begins that ends before ``at``."""
    while at > free and not text[at - 1].isspace() and text[at - 1] != stop:
        at -= 1
    return at


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text that may hold an entity, leftmost first: an address's run around its ``@``, one spelled out
    around its ``(at)``, digits with what joins them. Each part grows from its mark, so no run is read again."""

    def with_at(free: int):
        k = text.find("@", free)
        if k < 0:
            return None
        end = BREAK.search(text, k + 1)
        return _run_start(text, k, free, "@"), end.start() if end else len(text)

    def spelled(free: int):
        for mark in AT.finditer(text, free):
            k = mark.start()
            k = k - 1 if k > free and text[k - 1] == " " else k
            start = _run_start(text, k, free, "")
            if start < k and (m := SPELLED.match(text, start)):
                return m.span()
        return None

    def numbers(free: int):
        m = NUMBERS.search(text, free)
        return m.span() if m else None

    free, ways = 0, (with_at, spelled, numbers)
    ahead = [way(0) for way in ways]
    while any(ahead):
        a, b = min((x for x in ahead if x), key=lambda x: x[0])
        yield a, b
        free = max(b, free + 1)
        ahead = [way(free) if x and x[0] < free else x for way, x in zip(ways, ahead)]


_SHAPES = [
    re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", re.ASCII),
    re.compile(r"[\w.%+-]+ ?[\[(]at[\])] ?[\w-]+( ?(\.|[\[(]dot[\])]) ?[\w-]+)+", re.ASCII | re.IGNORECASE),
    re.compile(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}", re.ASCII),
    re.compile(r"(\+|00)\d{1,3}[ ()\d./-]{6,18}\d", re.ASCII),
    re.compile(r"0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,5}", re.ASCII),
    re.compile(r"\d{1,3}(\.\d{1,3}){3}", re.ASCII),
    re.compile(r"\d{4}([ -]\d{4}){2}[ -]\d{1,7}", re.ASCII),
    re.compile(r"\d{4}[-/.]\d{2}[-/.]\d{2}([ T]\d{2}(:\d{2}){1,2})?|\d{2}[-/.]\d{2}[-/.]\d{4}", re.ASCII),
]
N_FEATURES = 15 + len(_SHAPES) + 14


def features(text: str, a: int, b: int, n_tokens: int) -> list[int]:
    """The features that hold for the candidate ``text[a:b]``; each is a property of the whole span."""
    s = text[a:b]
    digits = "".join(c for c in s if c in "0123456789")
    on = [0, 1 + min(len(digits), 20) * 13 // 20]  # bias, digits in 14 steps
    on += [15 + k for k, shape in enumerate(_SHAPES) if shape.fullmatch(s)]
    rest = 15 + len(_SHAPES)
    before, after = text[a - 1 : a], text[b : b + 1]
    marks = (
        "@" in s,
        12 <= len(digits) <= 19 and luhn(digits),
        any(c.isalpha() for c in s),
        s[0] == "+",
        s.count("(") != s.count(")"),
        before.isalnum() or before in ("+", "@") and bool(before),
        after.isalnum() or after == "@",
        not (s[0].isalnum() or s[0] in "+("),
        not (s[-1].isalnum()),
        s.count(".") == 3 and all(0 < len(x) < 4 and x.isdigit() and int(x) < 256 for x in s.split(".")),
        before in (".", "-", "/") and bool(before),
        after in ("-", "/") and bool(after),
        n_tokens == 1,
        " " in s and not digits,
    )
    return on + [rest + k for k, yes in enumerate(marks) if yes]


def candidates(text: str, tokens: list[tuple[int, int]], first: int = 0, stop: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Segments (first token, length) that begin at tokens ``first`` to ``stop`` and their 0/1 feature rows."""
    spans, rows = [], []
    for i in range(first, len(tokens) if stop is None else min(stop, len(tokens))):
        for n in range(1, min(LONGEST, len(tokens) - i) + 1):
            a, b = tokens[i][0], tokens[i + n - 1][1]
            if n > 1 and (b - a > MOST_CHARACTERS or tokens[i + n - 1][0] - tokens[i + n - 2][1] > 1 or "\n" in text[tokens[i + n - 2][1] : tokens[i + n - 1][0]]):
                break
            spans.append((i, n))
            rows.append(features(text, a, b, n))
    x = np.zeros((len(spans), N_FEATURES), np.float64)
    for r, on in enumerate(rows):
        x[r, on] = 1.0
    return spans, x


def scores(weights: np.ndarray, x: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Segment scores by label; 'other' covers single tokens only."""
    s = x @ weights
    s[[k for k, (_, n) in enumerate(spans) if n > 1], 0] = -np.inf
    return s


def decode(weights: np.ndarray, text: str, tokens: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The best segmentation's entities. Candidates are scored ``STEP`` tokens at a time."""
    best, pick = np.full(len(tokens) + 1, -np.inf), [(0, 0)] * (len(tokens) + 1)
    best[0] = 0.0
    for at in range(0, len(tokens), STEP):
        spans, x = candidates(text, tokens, at, at + STEP)
        s = scores(weights, x, spans)
        label, top = s.argmax(1).tolist(), s.max(1).tolist()
        for k, (i, n) in enumerate(spans):  # by first token: best[i] is final
            if best[i] + top[k] > best[i + n]:
                best[i + n], pick[i + n] = best[i] + top[k], (n, label[k])
    out, j = [], len(tokens)
    while j:
        n, label = pick[j]
        if label:
            out.append((LABELS[label], tokens[j - n][0], tokens[j - 1][1]))
        j -= n
    return out[::-1]


# Training on generated lines


def _line(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rng.choice((d, " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4))))

    def email() -> str:
        a, b, c = f"{word()}{rng.choice(('', '.', '_'))}{digits(rng.randint(0, 3))}", word(), rng.choice(("com", "org", "de"))
        a, b = (re.sub("[^a-z0-9._]", "x", t) for t in (a, b))
        a = a.rstrip("._") or "x"
        return rng.choice((f"{a}@{b}.{c}", f"{a}@{b}.{c}", f"{a} [at] {b} [dot] {c}", f"{a}(at){b}.{c}"))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rng.randint(10, 99)} {a} {b} {c}", f"0{digits(3)} {digits(7)}"))

    makers = {"card": card, "email": email, "phone": phone, "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))}
    noise = (word, lambda: f"{word()}@", lambda: f"@{word()}", lambda: digits(rng.randint(1, 22)), lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{digits(2)}.{digits(2)}", lambda: ".".join(digits(rng.randint(1, 2)) for _ in range(3)), lambda: f"{digits(3)}.{rng.randint(256, 999)}.{digits(2)}.{digits(1)}", lambda: f"{digits(3)}-{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"{digits(4)} {digits(4)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(12, 40))))
    text, marks = "", []
    for _ in range(rng.randint(2, 5)):
        kind = rng.choice((*KINDS, None, None))
        part = makers[kind]() if kind else rng.choice(noise)()
        text += rng.choice((" ", " ", ", ", ": ", " ")) if text else ""
        if kind:
            marks.append((kind, len(text), len(text) + len(part)))
        text += part
        text += rng.choice(("", "", "", ".", ",", ";")) + " " + word()
    return text, marks


def train(lines: int = 600, epochs: int = 80, rate: float = 0.5, decay: float = 1e-4, seed: int = 11) -> np.ndarray:
    """Weights (features by labels) that maximise the conditional likelihood, by full-batch AdaGrad; all
    lines' lattices run side by side."""
    rng = random.Random(seed)
    data = []
    for _ in range(lines):
        text, marks = _line(rng)
        tokens = [m.span() for m in TOKEN.finditer(text)]
        spans, x = candidates(text, tokens)
        starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i for i, (_, b) in enumerate(tokens)}
        gold, inside = {}, set()
        for kind, a, b in marks:
            if a in starts and b in ends and ends[b] - starts[a] < LONGEST:
                gold[starts[a], ends[b] - starts[a] + 1] = LABELS.index(kind)
                inside |= set(range(starts[a], ends[b] + 1))
        gold |= {(i, 1): 0 for i in range(len(tokens)) if i not in inside}
        if set(gold) <= set(spans):
            data.append((len(tokens), spans, x, gold))
    size = max(n for n, *_ in data)
    count, y = len(data), len(LABELS)
    where = [np.array([(i, n - 1) for i, n in spans]).T for _, spans, _, _ in data]
    x_all = np.concatenate([x for _, _, x, _ in data])
    line_of = np.repeat(np.arange(count), [len(spans) for _, spans, _, _ in data])
    first, length = np.concatenate(where, axis=1)
    ends_at = np.array([n for n, *_ in data])
    target = np.zeros((len(x_all), y))
    at = 0
    for _, spans, _, gold in data:
        for k, span in enumerate(spans):
            if span in gold:
                target[at + k, gold[span]] = 1.0
        at += len(spans)
    weights, gathered = np.zeros((N_FEATURES, y)), np.full((N_FEATURES, y), 1e-8)
    for _ in range(epochs):
        s = x_all @ weights
        s[length > 0, 0] = -np.inf
        peak = s.max(1)
        total = peak + np.log(np.exp(s - peak[:, None]).sum(1))  # all labels of a segment
        grid = np.full((count, size + LONGEST, LONGEST), -np.inf)
        grid[line_of, first, length] = total
        ahead = np.full((count, size + LONGEST + 1), -np.inf)
        ahead[:, 0] = 0.0
        behind = np.full((count, size + LONGEST + 1), -np.inf)
        behind[np.arange(count), ends_at] = 0.0
        for i in range(size):
            for n in range(LONGEST):
                ahead[:, i + n + 1] = np.logaddexp(ahead[:, i + n + 1], ahead[:, i] + grid[:, i, n])
        for i in range(size - 1, -1, -1):
            for n in range(LONGEST):
                behind[:, i] = np.logaddexp(behind[:, i], grid[:, i, n] + behind[:, i + n + 1])
        through = ahead[line_of, first] + behind[line_of, first + length + 1] - ahead[np.arange(count), ends_at][line_of]
        slope = x_all.T @ (target - np.exp(s + through[:, None])) / count - decay * weights
        gathered += slope * slope
        weights += rate * slope / np.sqrt(gathered)
    return weights


@functools.cache
def default_weights() -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return train()


def field_spans(text: str, weights: np.ndarray) -> list[tuple[str, int, int]]:
    """The field's entities over a whole text."""
    out, done = [], 0
    for start, stop in stretches(text):
        part = text[start:stop]
        if "@" not in part and "at" not in part.lower() and sum(c in "0123456789" for c in part) < 7 and part.count(".") < 3:
            continue
        a = max(done, start - 24)
        around = [t.span() for t in TOKEN.finditer(text, a, min(len(text), stop + 24))]
        inner = [k for k, (x, y) in enumerate(around) if y > start and x < stop]
        if not inner:
            continue
        tokens = around[max(0, inner[0] - CONTEXT) : inner[-1] + 1 + CONTEXT]
        if a and tokens and tokens[0][0] == a and len(tokens) > len(inner) and text[a - 1].isalnum():
            tokens = tokens[1:]
        found = decode(weights, text, tokens)
        out += [s for s in found if s[1] >= done]
        done = max([done, start, *(b for _, _, b in found)])
    return out


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """doc_id and all spans of each whole text, with the strings themselves. A span of the field is added
    where it touches no pattern's span."""
    weights = default_weights() if weights is None else weights

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            rows: list[list] = [[]] * batch.num_rows
            for i in pc.indices_nonzero(pc.match_substring_regex(column, FILTER)).to_pylist():
                text = column[i].as_py()
                base = base_spans(text)
                added = _untouched(field_spans(text, weights), base)
                rows[i] = span_rows(text, base, added, KINDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, SPAN_TYPE)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, spans {SPANS}")


def _untouched(spans: list, base: list) -> list:
    """The spans that overlap none of ``base``: of those that begin before a span's end, none reaches beyond its start."""
    covered = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in covered], list(itertools.accumulate((b for _, b in covered), max))
    return [s for s in spans if not (n := bisect.bisect_left(starts, s[2])) or reach[n - 1] <= s[1]]


def op7_pii_field(spark, sf_dir: str) -> DataFrame:
    found = detected(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *digest_columns(found, KINDS))
