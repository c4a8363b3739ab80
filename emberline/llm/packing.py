"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are tokenised and end with id 0. Only those over `capacity` tokens are cut, into full pieces after a first
piece that may be shorter. Full pieces are sequences of their own. All other pieces are dealt by hash to leaves, and
each leaf packs its pieces best-fit, largest first. Bins that are nearly full are sequences; the others are the items
that go up the tree, whole: a node packs the bins of FAN_IN neighbours best-fit into bins, and so on up to one root,
which emits all that it has.

What goes up is bounded. A bin with less room than the smallest item left anywhere can take nothing and is emitted.
Best fit leaves at most one bin at most half full at a node, so all others wait for such a bin of another node; a node
sends its roomiest bins up, of PER_TASK / FAN_IN pieces at most, since what fits any bin fits a roomier one, and emits
the rest. So no node ever holds more than PER_TASK pieces, whatever the sizes.

Defined results: a null or empty text is the single id 0; rows that repeat an id are documents of their own, with equal
pieces; an empty table gives no rows; other columns are ignored, whatever they are called. Sequence numbers name round,
node and bin.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.shared import place, plain, stage, table

CAPACITY = 2048
#: A bin with at most this part of its room free is nearly full.
SLACK = 1 / 256
#: Pieces that a leaf packs at least, as far as there are so many, and nodes whose rests meet in one.
PER_TASK, FAN_IN = 5_000, 8

PIECE_SHAPE = "id {id}, piece int, start long, length long, ids_crc32 long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------------- ids


class DocumentIds:
    """The ids that the tokenizers library gives a text with a byte-level BPE file, without special tokens added.

    tiktoken encodes with the same ranks and split pattern several times faster than the tokenizers library; tests hold
    the two against each other. Strings of special tokens inside a text become their ids, as the library does by default.
    """

    def __init__(self, path: str, terminator: int = 0) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {t.content: i for i, t in Tokenizer.from_file(path).get_added_tokens_decoder().items()}
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special, self.terminator = list(special), terminator

    def __call__(self, text: str) -> bytes:
        """The ids and the terminator, as little-endian unsigned 32-bit numbers."""
        plain = not any(s in text for s in self.special)
        ids = self.coder.encode_ordinary(text) if plain else self.coder.encode(text, allowed_special="all")
        ids.append(self.terminator)
        return struct.pack(f"<{len(ids)}I", *ids)


#: Encoders that this worker process has read, by path.
_encoders: dict[str, DocumentIds] = {}


def encoder_for(path: str) -> DocumentIds:
    if path not in _encoders:
        _encoders[path] = DocumentIds(path)
    return _encoders[path]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length and ids_crc32 of each piece of each row of docs."""
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder_for(path)
        for batch in batches:
            of, rows = [], []
            for k, text in enumerate(batch.column("text")):
                data = ids_of(text.as_py() or "")
                for piece, (start, length) in enumerate(cut_points(len(data) // 4, capacity)):
                    of.append(k)
                    rows.append((piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
            numbers = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of, pa.int64())), *numbers], ["id", "piece", "start", "length", "ids_crc32"])

    texts = plain(docs).select(F.col(place(docs, id_col)).alias("id"), F.col(place(docs, text_col)).alias("text"))
    return texts.mapInArrow(pieces, PIECE_SHAPE.format(id=kind))


# ------------------------------------------------------------------ packing


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the free room of each bin: largest items first, each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, n = 0, 0  # bit r of some: a bin with r free exists
    room: list[int] = []
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some &= ~(1 << r)
        else:
            r, b = capacity, n
            room.append(capacity)
            n += 1
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - size
        if room[b]:
            by_room[room[b]].append(b)
            some |= 1 << room[b]
    return bins, offsets, np.array(room, np.int64)


def packed_node(number: int, last: bool, least: int, capacity: int, hand_up: int, names: list[str], length: str) -> Callable[[pa.Table], pa.Table]:
    """What a node of round `number` does with the rows of its items: pieces (round 0) or bins of the round before."""

    def packed(rows: pa.Table) -> pa.Table:
        col = lambda name: rows.column(name).to_numpy()
        order = np.lexsort((col("offset"), col("bin"), col("h")))
        rows = rows.take(pa.array(order))
        if number:
            _, first, item = np.unique(col("bin"), return_index=True, return_inverse=True)
            sizes = col("filled")[first]
        else:
            item, sizes = np.arange(len(order)), col(length)
        bins, offsets, room = best_fit(sizes, capacity)
        own = bins[item]
        done = np.ones(len(room), bool) if last else (room <= int(capacity * SLACK)) | (room < least)
        waiting = np.flatnonzero(~done)
        waiting = waiting[np.argsort(-room[waiting], kind="stable")]
        done[waiting[np.cumsum(np.bincount(own, minlength=len(room))[waiting]) > hand_up]] = True
        node = int(rows.column("node")[0].as_py())
        new = [col("h"), col("node") // FAN_IN, (number << 56) + (node << 32) + own, offsets[item] + col("offset"), (capacity - room)[own]]
        return pa.Table.from_arrays([*(rows.column(n) for n in names), *(pa.array(x, pa.int64()) for x in new), pa.array(done[own])], [*names, *NODE_COLUMNS, "done"])

    return packed


#: Of each piece beside its own columns: hash, node, its bin, its place there, and what the bin holds.
NODE_COLUMNS = ["h", "node", "bin", "offset", "filled"]


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_task: int = PER_TASK) -> DataFrame:
    """pieces (with a column length of at most capacity, and any others) with sequence_id and offset."""
    own, length = plain(pieces), place(pieces, "length")
    names, none = own.columns, F.lit(0).cast("long")
    items = stage(own.withColumn("h", F.xxhash64(*names)))
    full = F.col(length) >= capacity
    done = [items.where(full).select(*names, (F.monotonically_increasing_id() + F.lit(127 << 56)).alias("bin"), none.alias("offset"))]
    short = items.where(~full)
    n, least = short.agg(F.count("*"), F.coalesce(F.min(length), F.lit(0))).first()
    nodes = max(1, min(n // per_task, 1 << 20))
    # dealt out by what a piece is, so that a task that runs again packs the same rows in the same order
    rest = short.select(*names, "h", F.pmod("h", F.lit(nodes)).alias("node"), none.alias("bin"), none.alias("offset"), none.alias("filled"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + "".join(f", {c} long" for c in NODE_COLUMNS) + ", done boolean"
    number = 0
    while n:
        node = packed_node(number, nodes == 1, least, capacity, per_task // FAN_IN, names, length)
        out = stage(rest.groupBy("node").applyInArrow(node, shape))
        done.append(out.where("done").select(*names, "bin", "offset"))
        if nodes == 1:
            break
        rest = out.where("not done").drop("done")
        n, least = rest.agg(F.count("*"), F.coalesce(F.min("filled"), F.lit(0))).first()
        nodes, number = -(-nodes // FAN_IN), number + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.toDF(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id and offset."""
    return pack(tokenised_pieces(docs, id_col, text_col, path, capacity), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
