"""Best-fit packing of token sequences: local best fit, then a tree of rounds over the bins with room left."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.llm.common import documents, stored
from voltframe.llm.wordcache import Generations

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
SEPARATOR = 0
GROUP = 65536
FAN = 16
CARRY = 256
SLACK = 16
CACHE = 400_000

# White space for str.split that the tokenizer's pattern may see otherwise; such texts are encoded whole.
ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
# Characters that lower-case and compose one by one; in chunks of them the split pattern below finds what the tokenizer finds.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_CHUNKS = re.compile("[\n!-~À-ÖØ-öø-ÿ]*")
# The tokenizer's split pattern over these characters, and the line end that parts chunks.
SPLIT = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-zß-öø-ÿ0-9]+")
# No id has four such bytes, and the last byte of an id is 0.
PART = b"\xff\xff\xff\xff"


def byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write characters above ASCII: a letter for each byte, printable ones being themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordIds:
    """Token ids of texts as the tokenizer gives them, by way of caches of white-space chunks and of their words.

    The tokenizer never joins over white space and treats a chunk alike wherever it stands. Ids are
    little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = Generations(CACHE)
        self.words = Generations(CACHE)

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of split words: the tokenizer's merges alone."""
        out = []
        for word in words:
            ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        joined = "\n".join(chunks)
        if not PLAIN_CHUNKS.fullmatch(joined) or any(s in joined for s in self.special):
            plain = [c for c in chunks if PLAIN.fullmatch(c) and not any(s in c for s in self.special)]
            if len(plain) < len(chunks):
                known = dict(zip(plain, self._chunk_ids(plain))) if plain else {}
                odd = [c for c in chunks if c not in known]
                known.update(zip(odd, self.library(odd)))
                return [known[c] for c in chunks]
        words = SPLIT.findall(joined.lower())
        distinct = list(set(words) - {"\n"})
        ids = dict(zip(distinct, self.words.fill(distinct, self._word_ids)))
        ids["\n"] = PART
        return b"".join(map(ids.__getitem__, words)).split(PART)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if ODD_SPACE.search(t) else t.split() for t in texts]
        ids = self.chunks.fill([c for chunks in cut if chunks for c in chunks], self._chunk_ids)
        out, at = [], 0
        for text, chunks in zip(texts, cut):
            if chunks is None:
                out.append(self.library([text])[0])
            else:
                out.append(b"".join(ids[at : at + len(chunks)]))
                at += len(chunks)
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _cutting(path: str, capacity: int, separator: int, keep_ids: bool):
    end = np.array([separator], dtype="<u4").tobytes()
    size = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, found in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                found += end
                for k, at in enumerate(range(0, len(found), size)):
                    part = found[at : at + size]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item, largest first, each into the fullest bin that still holds it."""
    bins = np.zeros(len(sizes), dtype=np.int64)
    offsets = np.zeros(len(sizes), dtype=np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = made = 0  # bit r of mask: a bin with room r exists
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        if above := mask >> size:
            room = size + (above & -above).bit_length() - 1
            chosen = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, chosen, made = capacity, made, made + 1
        bins[k], offsets[k] = chosen, capacity - room
        if room > size:
            rooms[room - size].append(chosen)
            mask |= 1 << (room - size)
    return bins, offsets


BIN = "grp long, done boolean, seq long, fill int, uids array<long>, offsets array<int>"


def _round(level: int, capacity: int, last: bool):
    """One best-fit round over the bins of a group; bins nearly full, or not among the emptiest, are done."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.sort_by([("fill", "descending"), ("first", "ascending")])
        fills = table["fill"].to_numpy()
        bins, shifts = best_fit(fills, capacity)
        uids: dict[int, list] = {}
        offsets: dict[int, list] = {}
        fill: dict[int, int] = {}
        for k, (b, shift, own, places) in enumerate(zip(bins.tolist(), shifts.tolist(), table["uids"].to_pylist(), table["offsets"].to_pylist())):
            uids.setdefault(b, []).extend(own)
            offsets.setdefault(b, []).extend(shift + p for p in places)
            fill[b] = shift + int(fills[k])
        order = sorted(fill, key=lambda b: fill[b])
        carried = set() if last else {b for b in order[:CARRY] if fill[b] <= capacity - SLACK}
        return pa.table(
            {
                "grp": pa.array([group] * len(order), pa.int64()),
                "done": pa.array([b not in carried for b in order]),
                "seq": pa.array([(level << 56) + (group << 20) + k for k in range(len(order))], pa.int64()),
                "fill": pa.array([fill[b] for b in order], pa.int32()),
                "uids": pa.array([uids[b] for b in order], pa.list_(pa.int64())),
                "offsets": pa.array([offsets[b] for b in order], pa.list_(pa.int32())),
            }
        )

    return run


def pack_pieces(pieces: DataFrame, uid: str, length: str, capacity: int, group: int = GROUP) -> DataFrame:
    """``uid, sequence_id, offset`` for every piece, packed into bins of ``capacity``.

    Groups of about ``group`` pieces, drawn by hash so that each has the mix of the whole, are packed by best fit
    (decreasing). Best fit leaves at most one bin half empty per group. So only the ``CARRY`` emptiest bins of a
    group that are not within ``SLACK`` of full go on as items, ``FAN`` groups together, round by round to one root.
    """
    total = pieces.count()
    groups = max(1, -(-total // group))
    items = pieces.select(
        F.pmod(F.xxhash64(uid), F.lit(groups)).alias("grp"), F.col(length).cast("int").alias("fill"),
        F.array(F.col(uid)).alias("uids"), F.array(F.lit(0)).alias("offsets"), F.col(uid).alias("first"),
    )
    done, level = [], 0
    while True:
        bins = stored(items.groupBy("grp").applyInArrow(_round(level, capacity, groups == 1), BIN))
        done.append(bins.filter("done"))
        if groups == 1:
            break
        items = bins.filter("NOT done").select(
            F.floor(F.col("grp") / FAN).cast("long").alias("grp"), "fill", "uids", "offsets", F.element_at("uids", 1).alias("first")
        )
        groups, level = -(-groups // FAN), level + 1
    full = done[0]
    for more in done[1:]:
        full = full.unionByName(more)
    placed = full.select("seq", F.explode(F.arrays_zip("uids", "offsets")).alias("p"))
    return placed.select(F.col("p.uids").alias("uid"), F.col("seq").alias("sequence_id"), F.col("p.offsets").cast("long").alias("offset"))


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    separator: int = SEPARATOR,
    keep_ids: bool = False,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, the ``ids`` (binary) per piece.

    A document is its token ids and the separator; only one longer than the capacity is cut, into pieces of
    full capacity and a rest. Null and empty texts are the separator alone. Repeated rows are packed
    each. An empty table gives no piece. The pieces are stored once; only their lengths take part in packing.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType(
        [rows.schema["id"], T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
        + [T.StructField("ids", T.BinaryType())] * keep_ids
    )
    cut = rows.mapInArrow(_cutting(path or public_tokenizers.path(TOKENIZER), capacity, separator, keep_ids), schema)
    pieces = stored(cut.withColumn("_uid", F.monotonically_increasing_id()))
    placed = pack_pieces(pieces, "_uid", "length", capacity)
    return pieces.join(placed, pieces["_uid"] == placed["uid"]).drop("_uid", "uid")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
