"""Secret scans: three fixed patterns, and strings in sensitive places that zstandard can't compress.

A candidate is a string of token characters shortly after a word such as ``secret`` or ``auth``. A compressor
that is primed with a dictionary of identifiers (a fixed list and the most frequent words of the whole corpus)
compresses the text around it, with and without the candidate. The difference is what the candidate adds:
a few bytes for names and prose, nearly all of its length for a key. Candidates over a share of their length are
reported beside the patterns' spans, which always stay.

Texts are searched as bytes (all patterns are ASCII, so no match begins inside a character), a slice of texts
at a time; places are turned into code points at the end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_path, map_batches, materialise
from lumenfold.llm.encode import sliced
from lumenfold.llm.variants import word_counts

KINDS = ("assign", "access", "hex", "novel")
#: Searched in the ASCII lower case of a text.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
HEX = np.zeros(256, bool)
HEX[[*b"0123456789abcdef"]] = True

#: Words that make a place sensitive, standing by themselves or as part of an identifier.
SENSITIVE = re.compile(rb"(?<![a-z])(?:password|passwd|passphrase|pwd|secret|token|api_?key|access_?key|private_?key|signing_?key|encryption_?key|credentials?|auth|authorization|bearer|session_?id|cookie|salt)(?![a-z])")
TOKEN = re.compile(rb"[A-Za-z0-9+/_.=-]+")
REACH = 48  # bytes after a sensitive word in which a candidate begins
LEAST_TOKEN = 16  # bytes of a candidate
DIGIT, ALPHA, CASES = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]"), re.compile(rb"[a-z][A-Z]|[A-Z]{2}[a-z]")
AROUND = 128  # bytes on either side that a candidate is measured against
#: Bytes it adds for each of its own. At this level 95 of 100 random strings of 20 to 48 characters add more, and 95 of 100 names in mixed case add less.
NOVEL, LEVEL = 0.62, 19
DICTIONARY_BYTES = 64 << 10  # of the corpus' most frequent words
#: Names that code is full of.
IDENTIFIERS = """
access account address allocate append application argument array assert async attribute authentication authorization await base64 boolean break
buffer builder bytes callback catch channel char class client close command config configuration connection console const constructor container
content context continue controller cookie count create credential data database date debug decode default define delete description disable document
download else email enable encode environment error event example exception export false field file filter final finally float font format function
generate hash header host https import include index init initialize input insert integer interface javascript json keyboard length library local
localhost logger login message metadata method model module network null number object offset output parameter parent password path pattern payload
permission policy port position prefix private production protected public query reference register release remove render replace repository request
reset resource response result return router schema scope script search secret section select self sequence server service session settings signature
source standard start state static status stream string struct submit suffix switch table target template test thread throw timeout timestamp token
true type undefined update upload user username utils value variable vector version void volatile while width window wrapper write your_api_key_here
""".split()


def common_words(docs: DataFrame, most_bytes: int = DICTIONARY_BYTES, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The corpus' most frequent words of 6 letters or more, the most frequent last, within ``most_bytes``; all documents are counted.

    Words are told apart by classes of frequency, sixteen for each doubling, and whole classes are taken from the top while they fit: the
    driver sees one row a class and the words that are taken, whatever the corpus.
    """
    counts, path = materialise(word_counts(docs, 6, 0, id_col, text_col).where(F.length("word") <= 64), "secret-words")
    level = F.floor(16 * F.log2("n")).cast("int")
    least, room = None, most_bytes // 7
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["level"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["level"]
    top = sorted(counts.where(level >= least).collect(), key=lambda r: (-r["n"], r["word"])) if least is not None else []
    drop_path(docs.sparkSession, path)
    kept, size = [], 0
    for r in top:
        word = r["word"].encode()
        size += len(word) + 1
        if size > most_bytes:
            break
        kept.append(word)
    return b" ".join(kept[::-1])


class Novelty:
    """A compressor primed with identifiers."""

    def __init__(self, words: bytes):
        import zstandard as z

        primed = z.ZstdCompressionDict(words + b" " + " ".join(IDENTIFIERS).lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self._size = z.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def added(self, before: bytes, token: bytes, after: bytes) -> int:
        """Compressed bytes that the token adds to the text around it; all in lower case, as the dictionary is."""
        around = after + b"\n" + before
        return len(self._size(around + token)) - len(self._size(around))


def hex_runs(raw: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(HEX[raw].astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= LEAST["hex"]
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def base_spans(joined: bytes, lower: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches; those too short are dropped after they have been matched."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(lower) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(*m.span(), "access") for m in ACCESS.finditer(joined) if m.end() - m.start() >= LEAST["access"]]
    return found + [(a, b, "hex") for a, b in hex_runs(np.frombuffer(joined, np.uint8))]


def mixed(token: bytes) -> bool:
    """Letters and digits, or both cases: no plain word."""
    return bool(ALPHA.search(token) and DIGIT.search(token) or CASES.search(token))


def candidates(joined: bytes, lower: bytes, base: list[tuple[int, int, str]], ends: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, start of its text, end of its text) of token strings after sensitive words, outside the base spans."""
    taken, seen = sorted((a, b) for a, b, _ in base), 0  # tokens up to ``seen`` have been looked at
    starts, furthest = [a for a, _ in taken], []
    for _, b in taken:
        furthest.append(max(b, furthest[-1] if furthest else 0))
    for m in SENSITIVE.finditer(lower):
        k = bisect_right(ends, m.start())
        first, end = ends[k - 1] if k else 0, ends[k]
        for t in TOKEN.finditer(joined, max(m.end(), seen), end):
            if t.start() > m.end() + REACH:
                break
            seen = t.end()
            if t.end() - t.start() < LEAST_TOKEN or not mixed(t[0]):
                continue
            i = bisect_right(starts, t.end() - 1)  # base spans that begin before the token ends
            if i and furthest[i - 1] > t.start():
                continue
            yield t.start(), t.end(), first, end


def scan(texts: list[str | None], novelty: Novelty) -> list[list[tuple[str, int, int, int | None]]]:
    """For each text its spans (kind, start, end in code points, bytes that it adds) by start, then kind."""
    parts = [(t or "").encode() for t in texts]
    joined = b"\n".join(parts) + b"\n"  # in no pattern, so no match crosses texts
    lower, raw = joined.lower(), np.frombuffer(joined, np.uint8)
    ends = (np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)).tolist()
    base = base_spans(joined, lower)
    spans: list[tuple[int, int, str, int | None]] = [(a, b, kind, None) for a, b, kind in base]
    for a, b, first, end in candidates(joined, lower, base, ends):
        more = novelty.added(lower[max(first, a - AROUND) : a], lower[a:b], lower[b : min(end, b + AROUND)])
        if more >= NOVEL * (b - a):
            spans.append((a, b, "novel", more))
    out: list[list[tuple[str, int, int, int | None]]] = [[] for _ in texts]
    inner = np.flatnonzero((raw & 0xC0) == 0x80)  # bytes that begin no code point
    point = lambda x: x - int(np.searchsorted(inner, x))
    for a, b, kind, more in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        k = bisect_right(ends, a)
        zero = point(ends[k - 1] if k else 0)
        out[k].append((kind, point(a) - zero, point(b) - zero, more))
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.int64())])


def _scan(words: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words.value)
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "added"), s, strict=True)) for s in spans] for _, texts in sliced(b, "text") for spans in scan(texts, novelty)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(SPAN))], names=["doc_id", "spans"])

    return run


def secret_spans(docs: DataFrame, words: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (kind, start, end in code points, added).

    Base kinds: ``assign`` (the whole match, from its keyword on; its value has 8 characters or more), ``access`` and
    ``hex``. The method's kind is ``novel``, with the compressed bytes that the string adds. Spans are in order of start, then of
    kind. A null text counts as an empty one and has none; rows without an id and repeated rows are rows of their own.
    Other columns aren't read; an empty table gives no row. ``words``: what primes the compressor beside
    fixed identifiers; left out, the corpus' most frequent words, counted over all documents.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(common_words(docs, id_col=id_col, text_col=text_col) if words is None else words)
    return map_batches(rows, _scan(sent), "doc_id long, spans array<struct<kind: string, start: long, end: long, added: long>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text, for each row of ``secret_spans``."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
