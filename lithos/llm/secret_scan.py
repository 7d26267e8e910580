"""Secret scan: fixed patterns, and strings that a tokenizer packs badly."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base kinds in their order, each with its pattern, the group to measure and the least length of it.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
]
KINDS = [*(k for k, *_ in BASE), "random"]
_run = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Lengths of hex digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = {32, 40, 56, 64, 96, 128}
_uuid = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_integrity = re.compile(r"sha(1|256|384|512)-[A-Za-z0-9+/]+={0,2}")
_parts = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
PIECE = 4096


def default_vocabulary() -> str:
    """The path of a public byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def _encoder(path: str):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str, encode, ratio: float) -> bool:  # noqa: ANN001
    """Whether a run is a digest, an identifier or a plain number: random on purpose, or no string of letters.

    Letters of one case make no identifier: they also have to pack well, at over ``ratio`` characters a token.
    """
    if run.isdigit() or _uuid.fullmatch(run) or _integrity.fullmatch(run):
        return True
    if len(run) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return True
    if len(set(run)) < 8:  # rulers and padding
        return True
    # names in snake, kebab, path or camel case: mostly words of one case of four letters and more
    words = [w for w in _parts.findall(run) if len(w) >= 4 and w.isalpha()]
    letters = sum(map(len, words))
    return letters >= 0.6 * len(run) and letters > ratio * sum(len(encode(w[i : i + PIECE])) for w in words for i in range(0, len(w), PIECE))


def efficiency(run: str, encode) -> float:  # noqa: ANN001
    """Characters per token; long runs are encoded piece by piece, since their cost grows faster than they do."""
    return len(run) / sum(len(encode(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def scan(text: str | None, encode, ratio: float) -> list[tuple[int, int, int]]:  # noqa: ANN001
    """Spans ``(start, kind, end)`` in order; kind: the index in KINDS."""
    if not text:
        return []
    found = [(m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(BASE) for m in pattern.finditer(text) if len(m[group]) >= least]
    starts, ends = [], []  # of the stretches that base spans cover
    for s, _, e in sorted(found):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for m in _run.finditer(text):
        run = m[0].rstrip("=-_/+")
        if len(run) < 20 or known(run, encode, ratio) or efficiency(run, encode) > ratio:
            continue
        at = bisect_left(starts, m.end())
        if not at or ends[at - 1] <= m.start():
            found.append((m.start(), len(BASE), m.start() + len(m[0])))
    return sorted(found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = 2.2, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, spans)``, a row for each row of ``docs``, spans ``(kind, start, end)`` by start, then kind.

    Kinds assign, access and hex are patterns. Kind random: a run of 20 and
    more letters, digits and ``+/_=-`` of ``ratio`` characters a token at
    most, that is no digest, identifier or number and that no other span
    overlaps. Null and empty texts have no spans. The vocabulary is a path
    that every executor has; None: that of the installed package.

    An empty table gives no row. Long texts are read whole, in time in proportion
    to their length; long runs go to the tokenizer in pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary or default_vocabulary()).encode_ordinary
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t.as_py(), encode, ratio)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans)], names=["doc_id", "spans"])

    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    one = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(one))])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def redact(text: str, spans: list[dict]) -> str:
    """The text with ``[kind]`` in place of each span; of overlapping ones the first stands."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
            at = s["end"]
    return "".join([*out, text[at:]])


def base_digest(spans: list[dict]) -> str:
    """Hex SHA-256 of the base spans of a row, for tests."""
    return hashlib.sha256(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] != "random").encode()).hexdigest()


def digests(found: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans)`` from the spans."""
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(n, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
