"""Tables, manifests and scenes in files."""

from __future__ import annotations

import ctypes
import hashlib
import json
import uuid
from functools import cache, reduce
from importlib import import_module
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import ship


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A header line; a byte order mark before it is dropped from the first name."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def union_of_rows(parts: list[DataFrame]) -> DataFrame:
    """The rows of all, under the union of their columns in order of first appearance; what a part lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_csv(df: DataFrame | list[DataFrame], path: str) -> None:
    """Under a header; of several tables, that of all their columns."""
    df = union_of_rows(df) if isinstance(df, list) else df
    df.write.mode("overwrite").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One document a file."""
    reader = spark.read.option("multiLine", True)
    return reader.schema(schema).json(path) if schema else reader.json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_states(df: DataFrame, path: str, *keys: str, about: dict | None = None) -> None:
    """Arrays by key as Parquet, with facts about them in every file's footer (read_states gives both back).

    The rows are written beside `path` first and take its place when they are complete, so a reader finds the old or the
    new ones. The move is as atomic as the file system's rename.
    """
    spark = df.sparkSession
    note = json.dumps(about or {}, sort_keys=True)
    fresh, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.withMetadata(df.columns[-1], {"about": note}).write.partitionBy(*keys).parquet(fresh)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        raise OSError(f"cannot replace {path}")
    if not fs.rename(at(fresh), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"cannot put {path} in place")
    if had:
        fs.delete(at(old), True)


def read_states(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows that write_states wrote, and the facts about them."""
    df = spark.read.parquet(path)
    notes = [f.metadata["about"] for f in df.schema.fields if f.metadata and "about" in f.metadata]
    return df, json.loads(notes[0]) if notes else {}


def export_table(df: DataFrame, methods: list[str], method: str = "method", column: str = "dataset", order: list[str] | None = None) -> DataFrame:
    """The rows of the named methods, in the order of their datasets, then of the methods as named."""
    own = df.where(F.col(method).isin(list(methods)))
    return own.orderBy(*_position(column, order or []), F.array_position(F.array(*map(F.lit, methods)), F.col(method)))


def _position(column: str, order: list[str]) -> list[Column]:
    at = F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.col(column))
    return [F.when(at == 0, len(order) + 1).otherwise(at), F.col(column)]


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows by the position of their category in `order`, others after them by name."""
    return df.orderBy(*_position(column, order))


# Classes of files and the size from which a file is left for inspection.
LARGE_BYTES = 25 * 1024 * 1024
RAW_SUFFIXES = (".mat", ".bsq", ".hdr", ".tif", ".tiff")
BUILD_SUFFIXES = (".pyc", ".log", ".aux", ".out")
BUILD_FOLDERS = ("__pycache__", "node_modules", ".cache", "tmp")
OUTPUT_SUFFIXES = (".py", ".json", ".yaml", ".yml", ".csv", ".md", ".txt", ".npy", ".png")


def suffix_of(path: Column) -> Column:
    """The lower-cased suffix of the file's name, or an empty string; a name that only begins with a dot has none."""
    return F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)


def file_class(path: Column, size: Column, release: str = "release") -> Column:
    """What becomes of a file, by its path relative to the workspace and its size: the first rule that holds.

    release: the name of the folder that holds the release itself.
    """
    folders = F.split(F.lower(path), "/")
    suffix = suffix_of(path)
    among = lambda names: F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    return (
        F.when(F.split(path, "/")[0] == release, "included_release")
        .when(size >= LARGE_BYTES, "large_excluded")
        .when(suffix.isin(*RAW_SUFFIXES) | among(["data"]), "third_party_or_raw_data")
        .when(among(BUILD_FOLDERS) | suffix.isin(*BUILD_SUFFIXES), "temporary_or_build")
        .when(suffix == ".zip", "historical_archive")
        .when(suffix == ".ipynb", "historical_notebook")
        .when(suffix.isin(*OUTPUT_SUFFIXES), "supplied_code_or_output")
        .otherwise("other_excluded")
    )


#: The bytes that one task digests of a file before another goes on, and those it holds in memory meanwhile.
PIECE, BLOCK = 128 * 1024 * 1024, 1024 * 1024


@cache
def _openssl() -> ctypes.CDLL | None:
    """The library behind hashlib, for its plain SHA-256: it keeps its state in a struct of the caller's, which another task can go on with."""
    try:
        lib = ctypes.CDLL(import_module("_hashlib").__file__)
        return lib if lib.SHA256_Init and lib.SHA256_Update and lib.SHA256_Final else None
    except (ImportError, AttributeError, OSError):
        return None


def digest_further(path: str, size: int, at: int = 0, state: bytes = b"", piece: int = PIECE) -> tuple[str, int, int, bytes, str | None]:
    """A file's row after one more piece: path, size, the bytes digested, the state, and the SHA-256 once all are.

    Where Python comes without OpenSSL's library the whole file is one piece.
    """
    lib = _openssl()
    if lib is None:
        with open(path, "rb") as f:
            return path, size, size, b"", hashlib.file_digest(f, "sha256").hexdigest()
    held = ctypes.create_string_buffer(state, 128)
    if not state:
        lib.SHA256_Init(held)
    with open(path, "rb") as f:
        f.seek(at)
        end = min(at + piece, size)
        while at < end:
            block = f.read(min(BLOCK, end - at))
            if not block:
                raise OSError(f"{path} has become shorter than {size} bytes")
            lib.SHA256_Update(held, block, ctypes.c_size_t(len(block)))
            at += len(block)
    if at < size:
        return path, size, at, held.raw, None
    out = ctypes.create_string_buffer(32)
    lib.SHA256_Final(out, held)
    return path, size, at, b"", out.raw.hex()


def digest_in_pieces(spark: SparkSession, sizes: list[tuple[str, int]], piece: int = PIECE) -> list[tuple[str, str]]:
    """Path and SHA-256 of files that the executors can open. A round takes all unfinished files a piece further, side by side.

    A task reads one piece, or small files of less than two pieces in all. Only states and digests come to the driver.
    """
    ship(spark)
    todo, done = [(path, size, 0, b"") for path, size in sizes], []
    while todo:
        reads = [min(piece, size - at) for _, size, at, _ in todo]
        starts = [end - read for end, read in zip(accumulate(reads), reads, strict=True)]
        lots = [[row for _, row in lot] for _, lot in groupby(zip(starts, todo, strict=True), lambda x: x[0] // piece)]
        rows = spark.sparkContext.parallelize(lots, len(lots)).flatMap(lambda lot: [digest_further(*row, piece) for row in lot]).collect()
        done += [(path, sha256) for path, _, _, _, sha256 in rows if sha256]
        todo = [row[:4] for row in rows if not row[4]]
    return done


def manifest(spark: SparkSession, path: str, release: str = "release", skip: tuple[str, ...] = (), piece: int = PIECE) -> DataFrame:
    """relative_path, size_bytes, suffix, sha256 and category of every file under a folder, but for those with a folder or name in `skip`.

    The executors digest what Spark's binary reader gives, files up to a piece. Larger files, and those it passes over (hidden
    and empty ones), are digested in pieces by tasks that open them. Where the folder isn't one of `file:` (hdfs:// and the
    like) Python can't: the binary reader takes files of less than 2 GB there, the driver's JVM what is left, as streams.
    """
    files = list_files(spark, path, release, skip)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    root = at(path).getFileSystem(conf).resolvePath(at(path)).toUri()
    local = root.getScheme() == "file"
    most = piece if local else 1_999_999_999
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    passed = (F.col("size_bytes") == 0) | (F.col("size_bytes") > most) | name.rlike("^[._]") | F.col("relative_path").rlike(r"(^|/)[._][^/]*/")
    left, rest = files.where(passed).select("path", "relative_path", "size_bytes").collect(), []
    if local:
        paths = {f"{root.getPath()}/{r['relative_path']}".rstrip("/"): r for r in left}
        rest = [(paths[p]["path"], sha256) for p, sha256 in digest_in_pieces(spark, [(p, r["size_bytes"]) for p, r in paths.items()], piece)]
    else:
        for r in left:
            stream = at(r["path"]).getFileSystem(conf).open(at(r["path"]))
            rest.append((r["path"], jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
            stream.close()
    rest = spark.createDataFrame(rest, "path string, sha256 string")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= most).select("path", F.sha2("content", 256).alias("sha256"))
    digests = read.join(rest, "path", "left_anti").unionByName(rest)
    return files.join(digests, "path", "left").drop("path")


def list_files(spark: SparkSession, path: str, release: str = "release", skip: tuple[str, ...] = ()) -> DataFrame:
    """Path, relative_path, size_bytes, suffix and category of every file under a folder. The driver lists names and sizes; nothing is opened."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.makeQualified(root).toUri().getPath().rstrip("/")
    found, each = [], fs.listFiles(root, True)
    while each.hasNext():
        status = each.next()
        found.append((status.getPath().toString(), status.getPath().toUri().getPath()[len(top) + 1 :], status.getLen()))
    rows = spark.createDataFrame(found, "path string, relative_path string, size_bytes long")
    if skip:
        rows = rows.where(~F.arrays_overlap(F.split("relative_path", "/"), F.array(*map(F.lit, skip))))
    return rows.select("path", "relative_path", "size_bytes", suffix_of(F.col("relative_path")).alias("suffix"), file_class(F.col("relative_path"), F.col("size_bytes"), release).alias("category"))


def write_checksums(files: DataFrame, path: str) -> None:
    """A manifest as CSV, by relative path, under its header."""
    write_csv(files.select("relative_path", "size_bytes", "sha256").orderBy("relative_path"), path)


FAIRNESS = ("method", "family", "receives_true_K", "reported_repeats", "implementation", "adaptation", "spectral_input", "evaluation_mask", "labelled_tuning")


def fairness(spark: SparkSession, runs: DataFrame | None = None) -> DataFrame:
    """What each compared method is given; the facts of the reference protocol for its seven methods, in this project's words. runs (method, seed): then also n_runs and n_seeds, what a table of results has of each method."""
    five, scaled, own = "5 seeds", "bands scaled to unit deviation, then 20 principal components", "this project"
    rows = [
        ("region discovery", "proposed", "no", "one frozen partition, deterministic", own, "none", "band z-scores; 20 principal components for the neighbour search alone, all bands for diffusion"),
        ("PCA-KMeans", "classical", "yes", five, "Spark ML", "none", scaled),
        ("MiniBatch-KMeans", "classical", "yes", five, own, "none", scaled),
        ("FCM", "classical", "yes", five, own, "none", scaled),
        ("SLIC-KMeans", "classical", "yes", five, own + " with Spark ML", "none", scaled),
        ("DLSS", "modern hyperspectral", "yes", "seed 0; the same partition from seed 1 on 3 scenes", "published Octave source, not run here", "superpixel regions instead of dense pixel pairs", "20 standardised principal components"),
        ("S2DL", "modern hyperspectral", "yes", "seed 0; the same partition from seed 1 on 3 scenes", "published Octave source, not run here", "Octave stand-ins for graph, propagation and superpixels", "20 standardised principal components"),
    ]
    common = ("reference labels score the final partition only", "no")
    facts = spark.createDataFrame([r + common for r in rows], ", ".join(f"{c} string" for c in FAIRNESS))
    if runs is None:
        return facts
    counts = runs.groupBy("method").agg(F.count("*").alias("n_runs"), F.countDistinct("seed").alias("n_seeds"))
    return facts.join(counts, "method", "left").fillna(0, ["n_runs", "n_seeds"])
