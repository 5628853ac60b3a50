"""Secret scans: patterns of assigned, access and hexadecimal keys, and the token-efficiency test.

Natural words are cheap under a trained vocabulary; random strings take nearly a token for every two
characters. The test takes the unbroken strings of at least ``LEAST_CHARACTERS`` of a text, sets aside known digests, numbers
and identifiers (paths and names whose parts are short), and reports those whose characters per token stay under
a threshold, as a whole or in a long part. Letters alone are no excuse: words are told from keys by their ratio.

Edge cases: a null text is an empty one and has no spans. Repeated rows are independent. An empty
table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
LEAST_CHARACTERS = 20
MOST_CHARACTERS_PER_TOKEN = 2.2

#: The contract's patterns. A run of a class is taken whole, so length limits are asked of it at once.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")

#: Superset filters for the column kernels (RE2).
ASSIGN_FILTER = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
HEX_FILTER = r"[0-9a-f]{24}"
LONG_FILTER = rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARACTERS}}}"

LONG = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_CHARACTERS},}}")
#: Strings that look random and are no secrets: digests by their lengths, UUIDs, decimal numbers, paths and names of short parts.
KNOWN = re.compile(r"""[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}
    |[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}
    |[0-9-]+|/?([a-z0-9.]{1,15}/)+[a-z0-9.-]{0,15}|([A-Za-z]{1,15}[0-9]{0,4}[_-])+[A-Za-z]{0,15}[0-9]{0,4}|[+/_=-]+""", re.VERBOSE)
#: A part between separators that is long enough to be a key with a prefix.
PART = re.compile(r"[A-Za-z0-9+=]{16,}")


@functools.cache
def _encoding(ranks: str = RANKS):
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans (kind, start, end) in code points, kind by kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def random_spans(text: str, most: float = MOST_CHARACTERS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """The token-efficiency test's spans."""
    out = []
    for m in LONG.finditer(text):
        parts = [m[0], *(p for p in PART.findall(m[0]) if p != m[0])]  # a key with a prefix shows in its long part
        if not KNOWN.fullmatch(m[0]) and any(not KNOWN.fullmatch(p) and len(p) < most * len(_encoding().encode_ordinary(p)) for p in parts):
            out.append(("random", *m.span()))
    return out


def span_rows(text: str, base: list, added: list, kinds: tuple[str, ...]) -> list[dict]:
    """Spans by start, then kind as listed, then end."""
    every = [(*x, True) for x in base] + [(*x, False) for x in added if x not in base]
    return [{"kind": k, "start": a, "end": b, "text": text[a:b], "base": own} for k, a, b, own in sorted(every, key=lambda s: (s[1], kinds.index(s[0]), s[2]))]


SPANS = "array<struct<kind: string, start: long, end: long, text: string, base: boolean>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("base", pa.bool_())]))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = MOST_CHARACTERS_PER_TOKEN) -> DataFrame:
    """doc_id and all spans of each whole text, with the strings themselves."""
    kinds = (*BASE_KINDS, "random")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            hit = pc.match_substring_regex(column, ASSIGN_FILTER)
            for other in (pc.match_substring(column, "AKIA"), pc.match_substring_regex(column, f"{HEX_FILTER}|{LONG_FILTER}")):
                hit = pc.or_(hit, other)
            rows: list[list] = [[]] * batch.num_rows
            for i in pc.indices_nonzero(hit).to_pylist():
                text = column[i].as_py()
                rows[i] = span_rows(text, base_spans(text), random_spans(text, most), kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, SPAN_TYPE)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, spans {SPANS}")


def digest_columns(scanned_docs: DataFrame, kinds: tuple[str, ...]) -> list:
    """Counts by base kind, the base spans' digest and all spans, from a ``spans`` column."""
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return [*counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans")]


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *digest_columns(found, BASE_KINDS))
