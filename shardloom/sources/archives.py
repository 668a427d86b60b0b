"""Record archives: tar files of image and caption members, read as streams without unpacking."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_KINDS = ("jpg", "jpeg", "png")
TEXT_KINDS = ("txt", "caption")
ROWS = "shard string, position int, stem string, kind string, size bigint, content binary, damaged boolean"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it, on whatever machine this runs: any the cluster shares, not only local ones."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.partition(":")[2].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class _Counted:
    """A stream that remembers how it began and how much of it was read."""

    def __init__(self, source) -> None:
        self.source, self.size, self.first = source, 0, b""

    def read(self, n: int = -1) -> bytes:
        data = self.source.read(n)
        if not self.size:
            self.first = data[:3]
        self.size += len(data)
        return data

    def cut_off(self) -> bool:
        """Whether a plain archive, which is made of whole blocks, ended within one."""
        return self.size % tarfile.BLOCKSIZE != 0 and self.first not in (b"\x1f\x8b\x08", b"BZh", b"\xfd7z")


def members(source, pairs: int | None = None, bodies: bool = True) -> Iterator[tuple[int, str | None, str | None, int, bytes | None, bool]]:
    """``position, stem, kind, size, content, damaged`` of an archive's files, one after another.

    Reading ends once ``pairs`` images have met their texts. What precedes a
    damage is kept; the damage itself is a last row without a stem.
    """
    images: set[str] = set()
    texts: set[str] = set()
    position = -1
    source = _Counted(source)
    try:
        with tarfile.open(fileobj=source, mode="r|*") as archive:
            for position, member in enumerate(archive):
                if not member.isfile():
                    continue
                stem, _, kind = member.name.rpartition("/")[2].rpartition(".")
                kind = kind.lower()
                content = None
                if bodies:
                    file = archive.extractfile(member)
                    content = file.read() if file else b""
                    if len(content) < member.size:
                        raise EOFError
                yield position, stem, kind, member.size, content, False
                if pairs is not None and kind in IMAGE_KINDS + TEXT_KINDS:
                    (images if kind in IMAGE_KINDS else texts).add(stem)
                    if len(images & texts) >= pairs:
                        return
        if source.cut_off():
            raise EOFError
    except (tarfile.TarError, EOFError, OSError):
        yield position + 1, None, None, 0, None, True


def scan_members(spark: SparkSession, path: str, bodies: bool = True, pairs: int | None = None) -> DataFrame:
    """``shard, position, stem, kind, size, content, damaged`` of the members of the archives under ``path``.

    The driver lists names only; a task opens its archives and reads them as
    streams, so an archive may be of any size and reading ends early where
    ``pairs`` says so. Without ``bodies`` members are skipped over and contents are null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar*").load(path).select("path")
    names = ["shard", "position", "stem", "kind", "size", "content", "damaged"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                shard = name.rpartition("/")[2].partition(".")[0]
                system, at = located(name)
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(at) as source:
                    for row in members(source, pairs, bodies):
                        rows.append((shard, *row))
                        held += len(row[4] or b"")
                        if len(rows) == 500 or held > 32 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, ROWS)


def _kinds() -> tuple[Column, Column]:
    return F.col("kind").isin(*IMAGE_KINDS), F.col("kind").isin(*TEXT_KINDS)


def records(spark: SparkSession, path: str, per_shard: int | None = None, bodies: bool = True) -> DataFrame:
    """``shard, stem, position, image, caption`` of the complete records, in archive order.

    A record is an image and a text of the same stem; incomplete ones are
    dropped. ``per_shard`` keeps the first records of each archive to be
    complete and reads no further. Without ``bodies`` the same records come out
    with null contents.
    """
    image, text = _kinds()
    m = scan_members(spark, path, bodies, per_shard)
    paired = m.where(image | text).groupBy("shard", "stem").agg(
        F.min("position").alias("position"),
        F.min_by(F.when(image, F.col("content")), F.when(image, F.col("position"))).alias("image"),
        F.min_by(F.when(text, F.col("content")), F.when(text, F.col("position"))).alias("text"),
        F.bool_or(image).alias("i"),
        F.bool_or(text).alias("t"),
    )
    return paired.where("i AND t").select("shard", "stem", "position", "image", F.col("text").cast("string").alias("caption"))


def structural_checks(spark: SparkSession, path: str) -> DataFrame:
    """``shard, members, records, unpaired, empty_members, truncated``: what is wrong with an archive without decoding anything."""
    image, text = _kinds()
    m = scan_members(spark, path)
    stems = m.groupBy("shard", "stem").agg(
        F.max((F.coalesce(image, F.lit(False))).cast("int")).alias("i"), F.max(F.coalesce(text, F.lit(False)).cast("int")).alias("t"),
        F.count_if(~F.col("damaged")).alias("n"), F.count_if((F.col("size") == 0) & ~F.col("damaged")).alias("z"), F.bool_or("damaged").alias("d"),
    )
    return stems.groupBy("shard").agg(
        F.sum("n").alias("members"), F.sum(F.col("i") * F.col("t")).alias("records"), F.count_if(F.col("i") != F.col("t")).alias("unpaired"), F.sum("z").alias("empty_members"), F.bool_or("d").alias("truncated")
    )


def write_archives(df: DataFrame, folder: str, shard: str = "bin", stem: str = "slot", image: str = "image", caption: str = "caption") -> DataFrame:
    """One archive per shard number in a folder all executors see (by any URI they share); returns ``shard, records``.

    Archives are named by six digits, members by shard and four digits. A
    file appears whole: it is written under another name and then renamed.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        number = int(part[shard].iloc[0])
        system, base = located(folder)
        system.create_dir(base, recursive=True)
        target = f"{base}/{number:06d}.tar"
        with system.open_output_stream(f"{target}.part") as out, tarfile.open(fileobj=out, mode="w|") as archive:
            for r in part.sort_values(stem).itertuples(index=False):
                row = r._asdict()
                for kind, body in (("jpg", row[image]), ("txt", row[caption].encode())):
                    info = tarfile.TarInfo(f"{number:06d}_{int(row[stem]):04d}.{kind}")
                    info.size = len(body)
                    archive.addfile(info, io.BytesIO(body))
        system.move(f"{target}.part", target)
        return pd.DataFrame({"shard": [number], "records": [len(part)]})

    return df.groupBy(shard).applyInPandas(run, "shard bigint, records bigint")
