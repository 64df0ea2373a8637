"""Token files: little-endian u16 (or u32) ids, readable and writable in parallel.

A token file is a folder of part files plus ``_parts.json``, which lists the parts of the tasks that
succeeded. Read in that order, the parts are the bytes of one plain ``.bin`` file, which the reader
takes as well. An append is a version of its own: ``_parts-1.json`` and so on list the parts that were added, and
the file is the chain of all versions. A list is written last, so a failed append leaves the file as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from lexiloom.operators.kernels import flat_values
from lexiloom.shipping import ship
from lexiloom.sources.metadata import meta_fields

ship(__name__)

FORMAT = "token_file"
MANIFEST = "_parts.json"
DTYPES = {"u16": "<u2", "u32": "<u4"}
TOKENS_PER_PART = 1 << 26
TOKENS_PER_RANGE = 1 << 25
TOKENS_PER_ROW = 1 << 16
TOKENS_PER_BATCH = 1 << 20
# Tokens that are summed up at once.
TOKENS_PER_SUM = 1 << 18


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class _Part(WriterCommitMessage):
    """Parts written by one task: (name, first index, number of tokens)."""

    parts: list[tuple[str, int, int]]


@dataclass
class _Range(InputPartition):
    name: str
    skip: int
    first_idx: int
    n_tokens: int
    dtype: str


class TokenFile(DataSource):
    """``(first_idx BIGINT, tokens ARRAY<INT>)``: a run of consecutive tokens per row."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "first_idx bigint, tokens array<int>"

    def reader(self, schema) -> DataSourceReader:
        upto = self.options.get("version")
        return _Reader(self.options["path"], self.options.get("dtype", "u16"), None if upto is None else int(upto))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("dtype", "u16"), int(self.options.get("version", 0)))


def manifest_name(version: int) -> str:
    return MANIFEST if version == 0 else MANIFEST.replace(".", f"-{version}.")


def listed_parts(
    path: str, dtype: str, upto: int | None = None
) -> tuple[str, list[tuple[str, int, int]], int]:
    """The type of a token file, name, first index and number of tokens of each part, and the last version read."""
    files, root = file_system(path)
    if files.get_file_info(root).is_file:
        size, width = files.get_file_info(root).size, np.dtype(DTYPES[dtype]).itemsize
        if size % width:
            raise ValueError(f"{path} holds no whole number of {dtype} tokens")
        return dtype, [("", 0, size // width)], 0
    parts, version, kind = [], 0, dtype
    while True:
        with files.open_input_stream(f"{root}/{manifest_name(version)}") as stream:
            manifest = json.loads(stream.read())
        kind = manifest["dtype"]
        parts += manifest["parts"]
        following = files.get_file_info(f"{root}/{manifest_name(version + 1)}")
        if version == upto or following.type == fs.FileType.NotFound:
            return kind, parts, version
        version += 1


class _Reader(DataSourceReader):
    def __init__(self, path: str, dtype: str, upto: int | None = None) -> None:
        self.path, self.dtype, self.upto = path, dtype, upto

    def partitions(self) -> list[_Range]:
        dtype, parts, _ = listed_parts(self.path, self.dtype, self.upto)
        return [
            _Range(name, skip, first + skip, min(TOKENS_PER_RANGE, n - skip), dtype)
            for name, first, n in parts
            for skip in range(0, n, TOKENS_PER_RANGE)
        ] or [_Range("", 0, 0, 0, dtype)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.n_tokens == 0:
            return
        files, root = file_system(self.path)
        dtype = np.dtype(DTYPES[partition.dtype])
        with files.open_input_file(f"{root}/{partition.name}".rstrip("/")) as stream:
            stream.seek(partition.skip * dtype.itemsize)
            for at in range(0, partition.n_tokens, TOKENS_PER_BATCH):
                n = min(TOKENS_PER_BATCH, partition.n_tokens - at)
                ids = np.frombuffer(stream.read(n * dtype.itemsize), dtype)
                bounds = np.append(np.arange(0, n, TOKENS_PER_ROW), n).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))
                first = pa.array(bounds[:-1].astype(np.int64) + partition.first_idx + at)
                yield pa.RecordBatch.from_arrays([first, tokens], ["first_idx", "tokens"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, dtype: str, version: int = 0) -> None:
        self.path, self.dtype, self.version = path, dtype, version

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        """Rows come in index order; every gap starts a new part, named so that no retry reuses it."""
        files, root = file_system(self.path)
        files.create_dir(root, recursive=True)
        limit = np.iinfo(DTYPES[self.dtype]).max
        parts: list[tuple[str, int, int]] = []
        stream, expected = None, None
        for batch in iterator:
            values, sizes = flat_values(batch.column("tokens"))
            offsets = np.append(0, np.cumsum(sizes))
            first = batch.column("first_idx").to_numpy()
            if len(values) and (values.min() < 0 or values.max() > limit):
                raise ValueError(f"token id out of range for {self.dtype}")
            ends = first + np.diff(offsets)
            starts = np.flatnonzero(np.append(True, first[1:] != ends[:-1])) if len(first) else []
            for i, row in enumerate(starts):
                stop = starts[i + 1] if i + 1 < len(starts) else len(first)
                if stream is None or first[row] != expected:
                    if stream is not None:
                        stream.close()
                    name = f"part-{first[row]:020d}-{uuid.uuid4().hex}.bin"
                    stream = files.open_output_stream(f"{root}/{name}")
                    parts.append((name, int(first[row]), 0))
                run = values[offsets[row] : offsets[stop]]
                stream.write(run.astype(DTYPES[self.dtype]).tobytes())
                name, at, n = parts[-1]
                parts[-1], expected = (name, at, n + len(run)), ends[stop - 1]
        if stream is not None:
            stream.close()
        return _Part(parts)

    def commit(self, messages: list[_Part | None]) -> None:
        files, root = file_system(self.path)
        files.create_dir(root, recursive=True)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p[1])
        # the list comes into being whole, under a name that no reader looks for, and is then put in its place
        draft = f"{root}/_draft-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as stream:
            stream.write(json.dumps({"dtype": self.dtype, "parts": parts}).encode())
        files.move(draft, f"{root}/{manifest_name(self.version)}")

    def abort(self, messages: list[_Part | None]) -> None:
        files, root = file_system(self.path)
        for message in messages:
            for name, _, _ in message.parts if message else []:
                files.delete_file(f"{root}/{name}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenFile)


def refuse_written(path: str) -> None:
    files, root = file_system(path)
    if files.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} holds a token file")


def write_tokens(
    stream: DataFrame, path: str, dtype: str = "u16", tokens_per_part: int = TOKENS_PER_PART
) -> None:
    """Write ``stream(first_idx, tokens)``; parts hold equal ranges of the index.

    ``tokens`` is an ARRAY<INT>, or BINARY, each byte of which is an id: then bytes are moved and not ids.
    A path that holds a token file already is refused; ``append_tokens`` adds to it.
    """
    if dtype not in DTYPES:
        raise ValueError(f"dtype must be one of {sorted(DTYPES)}")
    refuse_written(path)
    _write_version(stream, path, dtype, 0, tokens_per_part)


def append_tokens(stream: DataFrame, path: str, tokens_per_part: int = TOKENS_PER_PART) -> int:
    """Add ``stream(first_idx, tokens)``, whose index starts at 0, after the last token; returns the new version.

    One writer at a time. The versions before stay readable, also when the append fails.
    """
    files, root = file_system(path)
    if files.get_file_info(root).is_file:
        raise ValueError(f"{path} is a plain file")
    dtype, parts, version = listed_parts(path, "u16")
    end = max((first + n for _, first, n in parts), default=0)
    moved = stream.withColumn("first_idx", F.col("first_idx") + F.lit(end).cast("bigint"))
    _write_version(moved, path, dtype, version + 1, tokens_per_part)
    return version + 1


def _write_version(stream: DataFrame, path: str, dtype: str, version: int, tokens_per_part: int) -> None:
    register(stream.sparkSession)
    part = F.floor(F.col("first_idx") / tokens_per_part)
    size = F.octet_length if stream.schema["tokens"].dataType.typeName() == "binary" else F.size
    (
        stream.where(size("tokens") > 0)
        .select("first_idx", "tokens", part.alias("part"))
        .repartition("part")
        .sortWithinPartitions("first_idx")
        .select("first_idx", "tokens")
        .write.format(FORMAT)
        .mode("append")
        .option("dtype", dtype)
        .option("version", version)
        .save(path)
    )


def read_tokens(spark: SparkSession, path: str, dtype: str = "u16", version: int | None = None) -> DataFrame:
    """All tokens; with ``version``, those that the file held after it."""
    register(spark)
    reader = spark.read.format(FORMAT).option("dtype", dtype)
    return (reader if version is None else reader.option("version", version)).load(path)


class _Seeker:
    """Reads ranges of a token file, each by seeking in the parts that hold it; ``bytes_read`` counts what was read."""

    def __init__(self, path: str, dtype: str) -> None:
        self.files, self.root = file_system(path)
        dtype, parts, _ = listed_parts(path, dtype)
        self.dtype = np.dtype(DTYPES[dtype])
        self.parts = sorted(parts, key=lambda p: p[1])
        self.firsts = np.array([p[1] for p in self.parts], np.int64)
        self.open_part, self.stream, self.bytes_read = None, None, 0

    def range(self, first: int, stop: int) -> np.ndarray:
        pieces = []
        i = max(0, int(np.searchsorted(self.firsts, first, side="right")) - 1)
        while i < len(self.parts) and self.parts[i][1] < stop:
            name, start, n = self.parts[i]
            low, high = max(first, start), min(stop, start + n)
            if low < high:
                if self.open_part != i:
                    self.close()
                    self.open_part = i
                    self.stream = self.files.open_input_file(f"{self.root}/{name}".rstrip("/"))
                self.stream.seek((low - start) * self.dtype.itemsize)
                data = self.stream.read((high - low) * self.dtype.itemsize)
                self.bytes_read += len(data)
                pieces.append(np.frombuffer(data, self.dtype).astype(np.int32))
            i += 1
        return np.concatenate(pieces) if pieces else np.empty(0, np.int32)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
        self.open_part, self.stream = None, None


def token_windows(draws: DataFrame, key: str, path: str, dtype: str = "u16") -> DataFrame:
    """(key, start_idx, n, tokens): the ``n + 1`` tokens of each drawn window of a token file.

    Map-only: no scan and no join. Draws are dealt to tasks by their start, and a task reads only the ranges of
    its draws, in order, by seeking. Where the file has a gap, a window is shorter.
    """
    kind = draws.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeker = None
        for batch in batches:
            seeker = seeker or _Seeker(path, dtype)
            starts, n = (batch.column(c).to_numpy() for c in ("start_idx", "n"))
            found = [seeker.range(int(a), int(a + k + 1)) for a, k in zip(starts, n)]
            sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.empty(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], [*batch.schema.names, "tokens"])
        if seeker is not None:
            seeker.close()

    wanted = draws.select(key, F.col("start_idx").cast("bigint"), F.col("n").cast("bigint"))
    ordered = wanted.repartitionByRange("start_idx").sortWithinPartitions("start_idx")
    return ordered.mapInArrow(read, f"{key} {kind}, start_idx bigint, n bigint, tokens array<int>")


def token_count(path: str, dtype: str = "u16") -> int:
    """Number of tokens, from the manifest or the file size alone."""
    return sum(part.n_tokens for part in _Reader(path, dtype).partitions())


def explode_tokens(tokens: DataFrame) -> DataFrame:
    """One row per token: (idx, token) after the other columns."""
    keep = [c for c in tokens.columns if c not in ("first_idx", "tokens")]
    exploded = tokens.select(*keep, "first_idx", F.posexplode("tokens").alias("_at", "token"))
    return exploded.select(*keep, (F.col("first_idx") + F.col("_at")).alias("idx"), "token")


def token_sums(tokens: DataFrame, per: int) -> DataFrame:
    """Number, sum and place-weighted sum of the tokens in each range of ``per`` indices.

    Each piece of a batch gives one row per run of tokens of one range; no token becomes a row.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = flat_values(batch.column("tokens"))
            ends = np.cumsum(sizes)
            shift = batch.column("first_idx").to_numpy() - (ends - sizes)
            for low in range(0, len(values), TOKENS_PER_SUM):
                piece = values[low : low + TOKENS_PER_SUM].astype(np.int64)
                at = np.arange(low, low + len(piece))
                part, place = np.divmod(at + shift[np.searchsorted(ends, at, side="right")], per)
                runs = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                n = np.diff(np.append(runs, len(piece)))
                columns = (part[runs], n, np.add.reduceat(piece, runs), np.add.reduceat(piece * place, runs))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    names = ["part", "n", "token_sum", "weighted_sum"]
    found = tokens.select("first_idx", "tokens").mapInArrow(sums, ", ".join(f"{c} bigint" for c in names))
    return found.groupBy("part").agg(*[F.sum(c).alias(c) for c in names[1:]])


def sidecars(train_path: str) -> tuple[str, str]:
    """The evaluation tokens and the metadata that lie next to the training tokens."""
    folder = train_path.rstrip("/").rpartition("/")[0] or "."
    return f"{folder}/eval.bin", f"{folder}/meta.json"


def write_corpus(
    streams: DataFrame,
    meta: DataFrame,
    directory: str,
    dtype: str = "u16",
    tokens_per_part: int = TOKENS_PER_PART,
) -> None:
    """Write ``streams(split, first_idx, tokens)`` of splits train and eval, and the metadata row."""
    for split in ("train", "eval"):
        refuse_written(f"{directory}/{split}.bin")
    for split in ("train", "eval"):
        write_tokens(streams.where(F.col("split") == split), f"{directory}/{split}.bin", dtype, tokens_per_part)
    meta.select("meta").coalesce(1).write.text(f"{directory}/meta.json")


def is_token_corpus(path: str) -> bool:
    return path.rstrip("/").endswith(".bin")


def load_corpus(spark: SparkSession, train_path: str) -> tuple[DataFrame, dict]:
    """Tokens of both splits (split, first_idx, tokens) and the metadata fields.

    Raises ``ValueError`` unless the tokens are u16, the vocabulary is not empty and each split has
    more than one token.
    """
    eval_path, meta_path = sidecars(train_path)
    text = spark.read.text(meta_path, wholetext=True)
    meta = text.select(meta_fields(F.col("value")).alias("m")).select("m.*").first().asDict()
    if meta["dtype"] != "u16":
        raise ValueError("only u16 token files are supported")
    if meta["vocab_size"] <= 0:
        raise ValueError("the metadata names no vocabulary size")
    tokens = (
        read_tokens(spark, train_path)
        .withColumn("split", F.lit("train"))
        .unionByName(read_tokens(spark, eval_path).withColumn("split", F.lit("eval")))
        .select("split", "first_idx", "tokens")
    )
    for path in (train_path, eval_path):
        if token_count(path) < 2:
            raise ValueError(f"{path} holds less than two tokens")
    return tokens, meta


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """Number, range and sum of the tokens of each split."""
    total = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda acc, t: acc + t)
    return tokens.where(F.size("tokens") > 0).groupBy("split").agg(
        F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"),
        F.min(F.array_min("tokens")).alias("min_token"),
        F.max(F.array_max("tokens")).alias("max_token"),
        F.sum(total).alias("token_sum"),
    )
