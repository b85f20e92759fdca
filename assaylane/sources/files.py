"""Reading raw exports, writing tables and results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylane.fixed import MISSING_MARKERS
from assaylane.functions.text import safe_float, strip
from assaylane.operators.columns import col
from assaylane.session import scratch_path
from assaylane.sources import versions
from assaylane.sources.digests import Sha256, workers_can_go_on
from assaylane.sources.rows import index_placed, placed

DELIMITERS = [",", ";", "\t", "|"]

# The characters of Windows-1252 that ISO-8859-1 reads as control characters 0x80-0x9F.
_CP1252 = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_CP1252 = {raw: real for raw, real in _CP1252.items() if real}


def latest_file(spark: SparkSession, folder: str, suffix: str = ".csv") -> str:
    """Newest file with the suffix (any case) in the folder itself; equal times go by path."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    if not versions.exists(spark, folder):
        raise FileNotFoundError(f"no such folder: {folder}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    newest = files.select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path").limit(1).collect()
    if not newest:
        raise FileNotFoundError(f"no {suffix} file in {folder}")
    return newest[0]["path"]


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    infer: bool = False,
    multi_line: bool = False,
    row_index: str | None = None,
) -> DataFrame:
    """Read a delimited export, a file or a folder of files with a header line each.

    Columns are text unless ``infer`` is set. Every file has a dialect of its own: the delimiter is the most frequent
    candidate in its header, and files that are not valid UTF-8 are read as Windows-1252. Files of one dialect and
    header are read together, and the tables are put under one another by column name; what a file does not have is
    null. Missing-value texts become null. Set ``multi_line`` for quoted line breaks; such files cannot be read in
    parts. ``row_index`` adds a stable number of the rows, see ``with_row_index``; the rows are then stored.
    """
    dialects = _dialects(spark, path)
    parts = [_read_dialect(spark, d, sep, multi_line) for d in dialects]
    if not parts:
        raise FileNotFoundError(f"no file with a header line: {path}")
    if row_index is not None:
        parts = [placed(part) for part in parts]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if row_index is not None:
        df = index_placed(df, row_index)
    return infer_types(df) if infer else df


@dataclass(frozen=True)
class Dialect:
    """What is needed to read some files: their paths, the header line, and whether they are UTF-8."""

    paths: tuple[str, ...]
    header: str
    utf8: bool

    @property
    def sep(self) -> str:
        return max(DELIMITERS, key=lambda d: (self.header.count(d), -DELIMITERS.index(d)))


def _dialects(spark: SparkSession, path: str) -> list[Dialect]:
    """The dialects of the files under a path, found in one pass over their lines; one row per dialect is read."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias("at"),
        "value",
    )
    by_file = lines.groupBy("path").agg(F.min_by("value", "at").alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    # lines of another encoding are read as the reader does, so that names come out as in the data
    header = F.when(F.col("utf8"), F.col("header")).otherwise(F.decode(F.col("header").cast("binary"), "ISO-8859-1"))
    found = by_file.groupBy(F.ltrim(header, F.lit("\ufeff")).alias("header"), "utf8").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [Dialect(tuple(r["paths"]), r["header"], r["utf8"]) for r in found.orderBy(F.col("paths")[0]).collect()]


def _read_dialect(spark: SparkSession, dialect: Dialect, sep: str | None, multi_line: bool) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep or dialect.sep).option("quote", '"').option("escape", '"')
    reader = reader.option("multiLine", multi_line).option("nanValue", "").option("emptyValue", "")
    df = reader.option("encoding", "UTF-8" if dialect.utf8 else "ISO-8859-1").csv(list(dialect.paths))
    names = [name.lstrip("\ufeff") for name in df.columns]
    if not dialect.utf8:
        names = [name.translate(str.maketrans(_CP1252)) for name in names]
    return df.select(*[_cell(col(raw), dialect.utf8).alias(name) for raw, name in zip(df.columns, names)])


def _cell(text: Column, utf8: bool) -> Column:
    if not utf8:
        text = F.translate(text, "".join(_CP1252), "".join(_CP1252.values()))
    return F.when(~text.isin(MISSING_MARKERS), text)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns to long, double or boolean where every value allows it, found in one pass."""
    whole, bools = r"^[+-]?[0-9]{1,18}$", ["True", "False", "TRUE", "FALSE", "true", "false"]
    checks = []
    for i, c in enumerate(df.columns):
        text = strip(col(c))
        checks += [
            F.count(col(c)).alias(f"n{i}"),
            F.bool_and(text.rlike(whole)).alias(f"long{i}"),
            F.bool_and(F.when(text.isNotNull(), safe_float(text).isNotNull())).alias(f"double{i}"),
            F.bool_and(col(c).isin(bools)).alias(f"boolean{i}"),
        ]
    found = df.agg(*checks).first() if checks else None

    def typed(i: int, c: str) -> Column:
        for kind in ("long", "double", "boolean"):
            if found[f"n{i}"] > 0 and found[f"{kind}{i}"]:
                return (safe_float(col(c)) if kind == "double" else strip(col(c)).try_cast(kind)).alias(c)
        return col(c)

    return df.select(*[typed(i, c) for i, c in enumerate(df.columns)])


# cells are written as they are, blanks at their ends included
CELLS = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a processed table: Parquet, or comma-separated text with a header."""
    writer = df.write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.csv(path, header=True, **CELLS)
    else:
        raise ValueError("fmt is 'parquet' or 'csv'")


_STAGED, _OLD = "__staged", "__old"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table as written by ``write_table`` or ``write_version``."""
    path = path.rstrip("/")
    if versions.is_versioned(spark, path):
        path = versions.current(spark, path)
    elif not versions.exists(spark, path) and versions.exists(spark, f"{path}{_OLD}"):
        path = f"{path}{_OLD}"  # a swap was cut short
    return spark.read.parquet(path) if fmt == "parquet" else read_delimited(spark, path, sep=",", infer=True, multi_line=True)


def write_version(df: DataFrame, root: str, fmt: str = "parquet") -> None:
    """Write ``df`` as the new version of a versioned table; readers see the old one until it is whole."""
    versions.replace(df.sparkSession, root, lambda folder: write_table(df, folder, fmt))


def enrich_table(
    spark: SparkSession, path: str, fn: Callable[[DataFrame], DataFrame], fmt: str = "parquet"
) -> DataFrame:
    """Replace a stored table by ``fn(table)``.

    A versioned table gets a new version. The folder of a plain one is swapped: the new table is written next to it,
    the old one moved aside, and ``read_table`` finds that one should the job stop between the two moves.
    """
    path = path.rstrip("/")
    if versions.is_versioned(spark, path):
        write_version(fn(read_table(spark, path, fmt)), path, fmt)
        return read_table(spark, path, fmt)
    staged, old = f"{path}{_STAGED}", f"{path}{_OLD}"
    write_table(fn(read_table(spark, path, fmt)), staged, fmt)
    if versions.exists(spark, path):
        versions.delete(spark, old)
        versions.rename(spark, path, old)
    versions.rename(spark, staged, path)
    versions.delete(spark, old)
    return read_table(spark, path, fmt)


def write_results(results: DataFrame, folder: str, date: str, prob: str = "Prob_activo", rank: str = "Rank") -> str:
    """Write the ranked results as ``resultados_<date>``: ``;`` separated, six decimals, in rank order.

    Every file starts with a byte order mark, so that spreadsheets read it as UTF-8; readers here drop it.
    """
    path = f"{folder.rstrip('/')}/resultados_{date}.csv"
    shown = results.withColumn(prob, F.format_string("%.6f", col(prob).cast("double")))
    ordered = shown.orderBy(col(rank)) if rank in results.columns else shown
    marked = ordered.toDF("\ufeff" + ordered.columns[0], *ordered.columns[1:])
    marked.write.mode("overwrite").csv(path, sep=";", header=True, **CELLS)
    return path


WHOLE_FILE = 256 << 20  # bytes of a file that is hashed in one piece
_PIECE = 8 << 20


def file_sha256(spark: SparkSession, path: str, whole: int = WHOLE_FILE, part: int = WHOLE_FILE) -> DataFrame:
    """``path, sha256`` of every file under ``path``, whatever its size.

    Files of more than ``whole`` bytes are read in parts by many tasks, and their pieces are stored in scratch. A
    digest needs them in order, so they feed it in rounds: in each, a task takes up the digest of a file where the
    round before left it and goes on with the next ``part`` bytes. No task reads much more than that, and none holds a
    file. Where Python's workers cannot take up a digest, see ``digests``, one task feeds it all pieces of a file.
    (Such files must not be compressed, and hold a line break at least every 2 GB.) Files without any byte do not
    show, as Spark's readers leave them out.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    large = [r["path"] for r in listed.where(F.col("length") > whole).collect()]
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= whole)
    small = files.select("path", F.sha2("content", 256).alias("sha256"))
    return small.union(_streamed_sha256(spark, large, part)) if large else small


def _streamed_sha256(spark: SparkSession, paths: list[str], part: int) -> DataFrame:
    stored = scratch_path(spark, "pieces")
    nth_part = F.floor(F.col("block") / part) if workers_can_go_on(spark) else F.lit(0).cast("long")
    # rows are of 8 MB, so the writer looks at its size after each
    options = {"parquet.block.size": str(4 * _PIECE), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
    _file_pieces(spark, paths).withColumn("part", nth_part).write.options(**options).partitionBy("part").parquet(stored)
    pieces = spark.read.schema(f"{_PIECE_SCHEMA}, part long").parquet(stored)

    sizes = pieces.groupBy("part", "path").agg(F.max("size").alias("size"), F.sum("n_bytes").alias("n_bytes")).collect()
    seen: dict[str, int] = {}
    for r in sizes:
        seen[r["path"]] = seen.get(r["path"], 0) + r["n_bytes"]
    # lines and breaks against the size of the file: a break too many, a byte order mark left out
    for r in sizes:
        if seen[r["path"]] - r["size"] not in (0, 1, -3, -2):
            raise ValueError(f"{r['path']}: cannot be read in parts")
    marked = {r["path"]: seen[r["path"]] < r["size"] for r in sizes}
    left = {r["path"]: r["size"] - 3 * marked[r["path"]] for r in sizes}

    state: dict[str, bytes | None] = dict.fromkeys(seen)
    digest: dict[str, str] = {}
    for nth in sorted({r["part"] for r in sizes}):
        due = [r["path"] for r in sizes if r["part"] == nth]
        known = [(i, p, marked[p], left[p], state[p]) for i, p in enumerate(due)]
        known = spark.createDataFrame(known, "file int, path string, marked boolean, left long, state binary")
        rows = pieces.where(F.col("part") == nth).join(F.broadcast(known), "path").drop("size", "n_bytes", "part")
        ordered = rows.repartitionById(len(due), "file").sortWithinPartitions("file", "block", "nth")
        for r in ordered.mapInArrow(_go_on, "path string, left long, state binary, sha256 string").collect():
            left[r["path"]], state[r["path"]] = r["left"], r["state"]
            if r["left"] == 0:
                digest[r["path"]] = r["sha256"]
    versions.delete(spark, stored)
    return spark.createDataFrame(list(digest.items()), "path string, sha256 string")


_PIECE_SCHEMA = "path string, size long, block long, nth long, n_bytes long, data binary"


def _file_pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The bytes of files in pieces, by the block that each piece lies in and its number there."""
    lines = spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of a part put together, each with its line break."""
        of, held, size, nth = None, [], 0, 0

        def piece() -> pa.RecordBatch:
            values = [[of[0]], [of[1]], [of[2]], [nth], [size], [b"".join(held)]]
            return pa.record_batch([pa.array(v, t) for v, t in zip(values, _PIECE_TYPES)], names=_PIECE_NAMES)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "block", "line"))):
                if held and (row[:3] != of or size > _PIECE):
                    yield piece()
                    held, size, nth = [], 0, nth + 1
                of = row[:3]
                held.append(row[3] + b"\n")
                size += len(held[-1])
        if held:
            yield piece()

    return lines.mapInArrow(pieces, _PIECE_SCHEMA)


_PIECE_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
_PIECE_NAMES = ["path", "size", "block", "nth", "n_bytes", "data"]


def _go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feed the pieces of a task's file, which come in order, to its digest; what is over at the end is left out."""
    of, digest, left = None, None, 0

    def reached() -> pa.RecordBatch:
        values = [of], [left], [digest.state()], [digest.hexdigest()]
        types = pa.string(), pa.int64(), pa.binary(), pa.string()
        return pa.record_batch([pa.array(v, t) for v, t in zip(values, types)], names=["path", "left", "state", "sha256"])

    for batch in batches:
        for i in range(batch.num_rows):
            path, data = batch.column("path")[i].as_py(), batch.column("data")[i].as_py()
            if path != of:
                if of is not None:
                    yield reached()
                of, left, state = path, batch.column("left")[i].as_py(), batch.column("state")[i].as_py()
                digest = Sha256(state)
                if state is None and batch.column("marked")[i].as_py():
                    digest.update(b"\xef\xbb\xbf")
            digest.update(data[:left])
            left -= min(left, len(data))
    if of is not None:
        yield reached()


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free checksum of all values: equal tables in any row order agree.

    Every cell is written with its kind and length, so null, an empty text and any marker text differ. The checksum
    is the sum of the 128-bit hashes of the rows, as two sums of 64 bits; repeated rows count each.
    """
    digest = F.md5(F.concat_ws("", *[_tagged(col(f.name), f.dataType) for f in df.schema.fields]))
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(38,0)"))
    text = lambda total: F.coalesce(total, F.lit(0)).cast("string")
    return df.agg(F.count("*").alias("n_rows"), F.concat_ws("-", text(half(1)), text(half(17))).alias("checksum"))


def _tagged(value: Column, kind: T.DataType) -> Column:
    """A cell as text that tells its kind, its length and its content; ``n`` for null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        tag, text = "f", value.cast("double").cast("string")
    elif isinstance(kind, T.IntegralType):
        tag, text = "i", value.cast("string")
    elif isinstance(kind, T.BinaryType):
        tag, text = "x", F.hex(value)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        tag, text = "j", F.to_json(value)
    else:
        tag, text = "s" if isinstance(kind, T.StringType) else "o", value.cast("string")
    return F.coalesce(F.concat(F.lit(tag), F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def scratch_copy(df: DataFrame, fmt: str = "parquet", **options: str) -> str:
    """Write ``df`` to a fresh scratch path and return the path."""
    path = scratch_path(df.sparkSession, fmt)
    df.write.options(**options).format(fmt).save(path)
    return path
