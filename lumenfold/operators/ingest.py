"""Ingestion: archives of publications to chunks with everything needed to cite them, to an index."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenfold.functions.text import token_estimate
from lumenfold.operators.chunking import check_unique, estimate, header, render, split_paragraph, within
from lumenfold.sources.publications import is_plausible, read_publications, shown

# Audiences by segment.
AUDIENCES = {"part": "particuliers", "pro": "entreprendre"}
TARGET, BUDGET, LIMIT = 600, 1200, 8192  # tokens of a chunk: wanted, of a paragraph, and that the embedding model reads


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(segment, day, path, sha256, size, content): the newest archive of each segment under ``path``, by names like ``part-2024-05-01.zip``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.regexp_extract(name, r"^(.*?)-\d{4}-\d{2}-\d{2}\.zip$", 1).alias("segment"), F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})\.zip$", 1).alias("day"), "path", F.col("length").alias("size"), "content")
    newest = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("day"), F.desc("path")))
    last = rows.where("segment <> ''").drop("content").withColumn("_n", newest).where("_n = 1").select("path")
    return rows.join(last, "path", "left_semi").select("segment", "day", "path", F.sha2("content", 256).alias("sha256"), "size", "content")


def members(archives_: DataFrame) -> DataFrame:
    """(segment, source_file, xml): the XML files of archives, without the folders they lie in; an archive that can't be read is an error that names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.string()), ("source_file", pa.string()), ("xml", pa.string())])
        for b in batches:
            for r in b.to_pylist():
                try:
                    bundle = zipfile.ZipFile(io.BytesIO(r["content"]))
                except zipfile.BadZipFile as e:
                    raise ValueError(f"{r['path']} is no readable zip archive") from e
                files = [(r["segment"], PurePosixPath(m).name, bundle.read(m).decode("utf-8", errors="replace")) for m in sorted(bundle.namelist()) if m.lower().endswith(".xml")]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], pa.string()) for i in range(3)], schema=schema)

    return archives_.select("segment", "path", "content").mapInArrow(run, "segment string, source_file string, xml string")


def manifest(archives_: DataFrame, files: DataFrame, version: str) -> DataFrame:
    """(segment, feed_version, path, sha256, size, documents): a row an archive, for the manifest."""
    n = files.groupBy("segment").agg(F.count("*").alias("documents"))
    return archives_.select("segment", F.lit(version).alias("feed_version"), "path", "sha256", "size").join(n, "segment", "left")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Documents once for each id and body: the first file stays and gets all ``segments``; other bodies of an id become ``id@segment``."""
    blocks = F.to_json(F.transform("sections", lambda s: F.struct(s["situation"].alias("a"), s["title"].alias("b"), s["blocks"].alias("c"))))
    rows = docs.where("status = 'document'").withColumn("_body", F.sha2(blocks.cast("binary"), 256))
    same = Window.partitionBy("doc_id", "_body")
    order = F.struct("segment", "source_file")
    rows = rows.withColumns({"_n": F.row_number().over(same.orderBy("segment", "source_file")), "segments": F.array_sort(F.collect_set("segment").over(same)), "_first": F.min(order).over(same)}).where("_n = 1")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("_first"))
    return rows.withColumn("_k", nth).withColumn("doc_id", F.when(F.col("_k") == 1, F.col("doc_id")).otherwise(F.concat("doc_id", F.lit("@"), "segment"))).drop("_body", "_n", "_first", "_k")


def parts_of(blocks: list[dict], target: int, budget: int, limit: int) -> list[tuple[str, list[str]]]:
    """(body, kinds of its blocks) of the chunks of one section.

    Blocks are put together up to the target; what may not be divided stands whole, a set of cases over the limit becomes a
    chunk a case, and a paragraph over the budget is cut between sentences.
    """
    groups: list[list[tuple[str, str]]] = []
    room = 0

    def put(kind: str, text: str, alone: bool = False) -> None:
        nonlocal room
        tokens = estimate(text)
        if alone or tokens > room or not groups:
            groups.append([])
            room = target
        groups[-1].append((kind, text))
        room = 0 if alone else max(0, room - tokens)

    for b in blocks:
        text, kind = shown((b["kind"], b["text"], b["items"], b["label"], b["url"])), b["kind"]
        if not text:
            continue
        tokens = estimate(text)
        if kind == "cases" and tokens > limit and len(b["items"]) > 1:
            for case in filter(str.strip, b["items"]):
                put(kind, render(kind, "", [case]), alone=True)
            room = 0
        elif tokens > budget and kind == "paragraph":
            for piece in split_paragraph(text, budget):
                put(kind, piece)
        else:
            put(kind, text)
    return [(part, [k for k, _ in g]) for g in groups for part in within("\n\n".join(t for _, t in g), limit)]


def chunks(docs: DataFrame, version: str, day: Column, today: Column, target: int = TARGET, budget: int = BUDGET, limit: int = LIMIT) -> DataFrame:
    """The chunks of deduplicated documents, with all that an index keeps of them. A document is chunked by itself; nothing is shuffled."""
    audience = lambda s: F.coalesce(F.try_element_at(F.create_map(*[x for k, v in AUDIENCES.items() for x in (F.lit(k), F.lit(v))]), s), s)
    rows = docs.select("*", F.posexplode("sections").alias("section", "s")).withColumn("header", header(F.col("title"), F.nullif("s.situation", F.lit("")), F.nullif("s.title", F.lit(""))))
    keep = ["doc_id", "title", "source_url", "last_updated", "last_major_update", "segment", "segments", "theme", "sub_theme", "doc_kind", "publication_type", "section", "s", "header"]
    added = T.StructType([T.StructField("part_index", T.IntegerType()), T.StructField("part_count", T.IntegerType()), T.StructField("body", T.StringType()), T.StructField("block_kinds", T.ArrayType(T.StringType()))])
    rows = rows.select(*keep)
    schema = T.StructType([*rows.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(added)
        for b in batches:
            at, made = [], []
            for i, (s, head) in enumerate(zip(b.column("s").to_pylist(), b.column("header").to_pylist(), strict=True)):
                used = estimate(head)
                parts = parts_of(s["blocks"], max(1, target - used), max(1, budget - used), limit - used)
                at += [i] * len(parts)
                made += [(n, len(parts), body, names) for n, (body, names) in enumerate(parts, 1)]
            new = [pa.array([m[j] for m in made], f.type) for j, f in enumerate(kinds)]
            taken = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *new], names=[*b.schema.names, *kinds.names])

    got = rows.mapInArrow(run, schema)
    text = F.concat("header", F.lit("\n\n"), "body")
    others = F.transform(F.array_except("segments", F.array("segment")), audience)
    return got.select(
        F.format_string("%s#%03d#%02d", "doc_id", "section", "part_index").alias("chunk_id"), text.alias("text"), F.col("doc_id").alias("fiche_id"), F.col("title").alias("fiche_title"), F.col("s.title").alias("section_title"),
        F.col("s.situation").alias("situation"), F.array_join("s.path", " > ").alias("section_path"), "source_url", "last_updated", is_plausible(F.col("last_updated"), today).alias("last_updated_is_plausible"), "last_major_update",
        audience(F.col("segment")).alias("audience"), "theme", "sub_theme", "doc_kind", "publication_type", F.lit(version).alias("feed_version"), day.alias("ingested_at"), "part_index", "part_count", token_estimate(text).alias("token_count"),
        F.arrays_overlap("block_kinds", F.array(F.lit("list"), F.lit("checklist"))).alias("contains_document_list"), F.array_contains("block_kinds", "ordered_list").alias("contains_numbered_procedure"),
        F.array_join(others, ", ").alias("also_published_for"), "block_kinds",
    )


def metadata(chunks_: DataFrame) -> DataFrame:
    """What the index stores beside text and vector: scalars only, empty text for null."""
    return chunks_.select(*[F.coalesce(c, F.lit("")).alias(c) if kind == "string" else F.col(c) for c, kind in chunks_.dtypes if c not in ("text", "block_kinds")])


def ingest(files: DataFrame, version: str, day: Column, today: Column) -> DataFrame:
    """Files (source_file, segment, xml) to chunks: read, deduplicated, chunked, each id once."""
    return check_unique(chunks(deduplicate(read_publications(files)), version, day, today), "chunk_id")


def embed(df: DataFrame, text: str, out: str = "embedding", dim: int = 256) -> DataFrame:
    """``df`` with a unit vector of hashed words of each text, zero where there are none: what stands in for an embedding model where none is installed."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        from lumenfold.functions.facts import words

        for b in batches:
            v = np.zeros((b.num_rows, dim), np.float32)
            for i, t in enumerate(b.column(text).to_pylist()):
                for w in words(t or ""):
                    h = zlib.crc32(w.encode())
                    v[i, h % dim] += 1 if h >> 31 else -1
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, vectors], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def write_index(df: DataFrame, path: str, shard_col: str, shards: int = 64) -> None:
    """The collection of vectors: Parquet in shards by a hash of the id, written anew."""
    df.withColumn("shard", F.pmod(F.xxhash64(shard_col), F.lit(shards)).cast("int")).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_index(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of all rows; others aren't read."""
    return spark.read.parquet(path).select(*columns)


