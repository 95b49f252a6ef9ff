"""Readers: every source comes out in the raw-record columns."""

from __future__ import annotations

import gzip
import io
import zlib
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

RAW = ST.StructType(
    [ST.StructField(n, ST.StringType()) for n in ("source_id", "source_record_id", "text", "license", "domain", "register")]
    + [ST.StructField("acquired_at", ST.TimestampType()), ST.StructField("source_config", ST.StringType()), ST.StructField("source_date", ST.StringType())]
    + [ST.StructField("upstream_language", ST.StructType().add("lang", "string").add("score", "double")), ST.StructField("extra", ST.MapType(ST.StringType(), ST.StringType()))]
)
#: What a source's records have in common (fixed values).
SOURCES = {"fw": ("odc-by", "web", "informational"), "fwe": ("odc-by", "academic", "informational"), "gut": ("public-domain-us", "books", "literary"), "gov": ("public-domain-us", "government", "formal"), "cc": ("common-crawl-terms", "web", "informational")}
BOOK_START, BOOK_END = "*** START OF", "*** END OF"
DROPPED_TAGS = {"script", "style", "nav", "header", "footer", "aside", "noscript"}


def as_raw(df: DataFrame, source: str, **columns) -> DataFrame:
    """``df`` in the raw columns; those not given are the source's or null."""
    license_, domain, register = SOURCES.get(source, ("unknown", "web", "informational"))
    given = {"source_id": F.lit(source), "license": F.lit(license_), "domain": F.lit(domain), "register": F.lit(register), "acquired_at": F.current_timestamp()} | columns
    return df.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW))


def web_rows(df: DataFrame, source: str, min_language_score: float | None = None, min_edu_score: int | None = None) -> DataFrame:
    """Hosted web corpora: rows (id, text, language, language_score, url[, int_score]) with both score filters pushed to the scan."""
    if min_language_score is not None:
        df = df.where(F.col("language_score") >= min_language_score)
    if min_edu_score is not None:
        df = df.where(F.col("int_score") >= min_edu_score)
    extra = F.create_map(F.lit("url"), F.col("url"), *((F.lit("edu_score"), F.col("int_score").cast("string")) if "int_score" in df.columns else ()))
    return as_raw(df, source, source_record_id=F.col("id"), text=F.col("text"), upstream_language=F.struct(F.col("language").alias("lang"), F.col("language_score").cast("double").alias("score")), extra=extra)


def book_body(text: Column) -> Column:
    """Text between the licence header's line and the footer; texts without them stay whole."""
    start = F.instr(text, BOOK_START)
    after = F.when(start > 0, F.regexp_replace(F.substr(text, start), r"(?s)^[^\n]*\n", "")).otherwise(text)
    end = F.instr(after, BOOK_END)
    return F.regexp_replace(F.when(end > 0, F.substr(after, F.lit(1), end - 1)).otherwise(after), r"(?U)^\s+|\s+$", "")


def text_files(spark: SparkSession, path: str, source: str, strip_book: bool = False) -> DataFrame:
    """One record per file, named by the file's stem."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1)
    return as_raw(files.withColumn("_n", name), source, source_record_id=F.col("_n"), text=book_body(F.col("value")) if strip_book else F.col("value"))


def jsonl(spark: SparkSession, path: str, source: str = "local", limit: int | None = None) -> DataFrame:
    """JSON lines with per-row overrides of licence, domain, register and date; ids default to the 0-based line number."""
    from siltstone.runtime import numbered

    # in order of file, block and row within the block's task
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    df = numbered(lines, "n", "_file", "_block", "_row")
    if limit is not None:
        df = df.where(F.col("n") < limit)
    row = F.from_json("line", "id string, text string, license string, domain string, register string, date string").alias("r")
    df = df.select(row, "n")
    own = lambda c, default: F.coalesce(F.col(f"r.{c}"), F.lit(default))
    return as_raw(df, source, source_record_id=F.coalesce("r.id", F.col("n").cast("string")), text=own("text", ""), license=own("license", "unknown"), domain=own("domain", "web"), register=own("register", "informational"), source_date=F.col("r.date"))


def reserve(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Pool documents of the Parquet files under ``path``, as ``reserve_rows``; only the columns needed are read."""
    return reserve_rows(spark.read.parquet(path), limit)


def reserve_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Pool documents in order of id: required columns checked, blank texts skipped, missing domain and register defaulted."""
    missing = sorted({"doc_id", "source_group_id", "text"} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    generated = sorted({"generator", "label", "sample_id"} & set(df.columns))
    if generated:
        raise ValueError(f"this is a pool of generated text: it has {generated}")
    opt = lambda c, default: F.coalesce(c, F.lit(default)).alias(c) if c in df.columns else F.lit(default).alias(c)
    rows = df.where(F.trim("text") != "").select("doc_id", "source_group_id", "text", opt("source", "unknown"), opt("domain", "unknown"), opt("register", "informational"))
    return rows.orderBy("doc_id").limit(limit) if limit is not None else rows


def parts(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files under a folder by the columns they hold; folder names add none (the columns are in the files as well)."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)


def humans(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(doc_id, source_group_id, text, domain, split) of a written corpus, or its nested sample of ``limit`` rows."""
    from siltstone.operators.sampling import subsample

    rows = parts(spark, path).select("doc_id", "source_group_id", "text", "domain", "split")
    return rows if limit is None else subsample(rows, "doc_id", limit)


def length_pool(rows: DataFrame) -> DataFrame:
    """(token_count, n): the lengths of a corpus (token_count) with their numbers."""
    return rows.where("token_count is not null").groupBy("token_count").agg(F.count("*").alias("n"))


def training_rows(human: DataFrame | None, ai: DataFrame | None, mixed: DataFrame | None, splits: list[str] = ("train", "val", "test")) -> DataFrame:
    """(doc_id, source_group_id, split, text, label, spans, domain, generator_family, generator_released) of the given sets.

    Human and machine texts have one span over the whole; a mixed text is machine (1) if spans that aren't human hold at least half of its
    characters. Rows of other splits are left out; a missing domain or family is unknown, a missing release the empty string.
    """
    from siltstone.operators.spans import marked_fraction, whole_span

    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    n = F.length("text")
    common = ["doc_id", "source_group_id", "split", "text"]
    made = []
    for rows, label in ((human, 0), (ai, 1)):
        if rows is not None:
            family, released = (unknown(F.col("generator_family")), F.coalesce("generator_released", F.lit(""))) if label else (F.lit("unknown"), F.lit(""))
            kind = F.lit("ai_generated" if label else "human")
            made.append(rows.select(*common, F.lit(label).alias("label"), whole_span(n, kind).alias("spans"), unknown(F.col("domain")).alias("domain"), family.alias("generator_family"), released.alias("generator_released")))
    if mixed is not None:
        label = (marked_fraction(F.col("spans"), n) >= 0.5).cast("int")
        made.append(mixed.select(*common, label.alias("label"), "spans", unknown(F.col("domain")).alias("domain"), F.lit("unknown").alias("generator_family"), F.lit("").alias("generator_released")))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.where(F.col("split").isin(*splits))


def capped(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows, whatever is filtered afterwards."""
    return rows.orderBy(*order).limit(most)


def quota_report(rows: DataFrame, source: str, keep: Column, wanted: int, multiplier: int, *order: Column) -> DataFrame:
    """(source, seen, kept, wanted, taken, keep_rate, short) if each source is read up to ``wanted * multiplier`` rows in order and gives its first ``wanted`` that pass.

    A reader can't stop early behind a shuffle, so the input is bounded before it.
    """
    from siltstone.operators.sampling import per_group

    read = per_group(rows.withColumn("_ok", F.coalesce(keep, F.lit(False))), [source], wanted * multiplier, *order)
    per = read.groupBy(source).agg(F.count("*").alias("seen"), F.count_if("_ok").alias("kept"))
    return per.select(source, "seen", "kept", F.lit(wanted).alias("wanted"), F.least("kept", F.lit(wanted)).alias("taken"), F.bround(F.col("kept") / F.col("seen"), 4).alias("keep_rate"), (F.col("kept") < wanted).alias("short"))


def training_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct content hashes of a written corpus; an empty one is an error."""
    hashes = spark.read.parquet(path).select("content_sha256").distinct()
    if hashes.isEmpty():
        raise ValueError(f"no training hashes under {path}")
    return hashes


class _Body(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts, self.body, self.all = 0, [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED_TAGS:
            self.depth += 1
        elif tag == "body":
            self.body = len(self.all)

    def handle_endtag(self, tag):
        if tag in DROPPED_TAGS and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.all.append(data.strip())


def html_text(payload: bytes | str) -> str:
    """Main text of a page or HTTP response: body text without scripts, navigation and the like, joined by line feeds."""
    if isinstance(payload, bytes):
        payload = payload.split(b"\r\n\r\n", 1)[-1].decode("utf-8", errors="replace")
    parser = _Body()
    parser.feed(payload)
    parser.close()
    return "\n".join(parser.all[parser.body or 0 :])


def warc_records(stream):
    """(headers, payload) of the records of an open WARC or WET file, gzipped by member or plain, one at a time; a cut-off record is an error."""
    stream = io.BufferedReader(stream, 1 << 20)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", errors="replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        size = int(headers.get("content-length", "0"))
        payload = stream.read(size)
        if len(payload) != size:
            raise EOFError("the record is cut off")
        yield headers, payload


def opened(path: str):
    """An open binary stream of a local file or of one on a file system pyarrow knows."""
    if path.startswith(("/", "file:")):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb", buffering=0)
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


SEGMENT_COLUMNS = ["segment", "id", "text", "date", "url", "lang", "length"]
ATTEMPTS = 3


def warc_segments(spark: SparkSession, path: str, fmt: str = "wet", crawl: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw records of crawl segments and one stats row per segment (segment, n_records, error).

    A segment is read twice, record by record: first to its end, so that a broken one gives an error row and no
    records, then for its records. A failing read is tried again, ATTEMPTS times in all. Blank texts are dropped.
    """
    wanted = "conversion" if fmt == "wet" else "response"

    def texts(segment):
        with opened(segment) as stream:
            for headers, payload in warc_records(stream):
                if headers.get("warc-type") == wanted:
                    text = html_text(payload) if fmt == "warc" else payload.decode("utf-8", errors="replace")
                    if text.strip():
                        yield headers, text

    def fault(segment):
        for attempt in range(ATTEMPTS):
            try:
                return sum(1 for _ in texts(segment)), None
            except (EOFError, ValueError, zlib.error, gzip.BadGzipFile) as e:  # the file itself is broken
                return 0, f"{type(e).__name__}: {e}"
            except OSError as e:
                error = f"{type(e).__name__}: {e}"
        return 0, error

    def packed(rows, stats):
        cols = list(zip(*rows)) if rows else [[] for _ in SEGMENT_COLUMNS]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols] + [pa.array([stats] * len(rows), pa.bool_())], [*SEGMENT_COLUMNS, "stats"])

    def scan(batches):
        for batch in batches:
            for segment in batch.column(0).to_pylist():
                n, error = fault(segment)
                rows, size = [], 0
                for headers, text in texts(segment) if error is None else ():
                    rows.append((segment, headers.get("warc-record-id", "").strip("<>"), text, headers.get("warc-date"), headers.get("warc-target-uri", ""), headers.get("warc-identified-content-language"), headers.get("content-length")))
                    size += len(text)
                    if size > 8_000_000:
                        yield packed(rows, False)
                        rows, size = [], 0
                yield packed(rows, False)
                yield packed([(segment, None, None, None, None, error, str(n))], True)

    from siltstone.runtime import cut

    files = spark.read.format("binaryFile").load(path).select("path")  # the listing only; contents are read as streams
    width = spark.sparkContext.defaultParallelism
    rows = cut(files.repartition(width, "path").mapInArrow(scan, "segment string, id string, text string, date string, url string, lang string, length string, stats boolean"))
    docs = rows.where("not stats")
    extra = F.create_map(*(x for k, c in (("url", "url"), ("segment", "segment"), ("cc_language", "lang"), ("content_length", "length")) for x in (F.lit(k), F.col(c))), F.lit("crawl"), F.lit(crawl).cast("string"))
    records = as_raw(docs, "cc", source_record_id=F.col("id"), text=F.col("text"), source_config=F.lit(crawl), source_date=F.col("date"), extra=extra)
    return records, rows.where("stats").select("segment", F.col("length").cast("int").alias("n_records"), F.col("lang").alias("error"))


READERS = {"fw": web_rows, "fwe": web_rows, "gut": text_files, "gov": text_files, "cc": warc_segments, "local": jsonl}


def reader(source: str):
    """The reader of a source id; an unknown one is an error."""
    if source not in READERS:
        raise ValueError(f"unknown source {source!r}; known: {sorted(READERS)}")
    return READERS[source]
