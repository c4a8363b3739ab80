"""Substring dedup over sliding sentence spans.

A text is cut into sentences. From each sentence on, the run of RUN sentences, or of as many more as make up MIN_WORDS
words, is hashed to 96 bits. All documents' runs are joined by hash: the run in the document with the smallest id, and
there at its first place, stays; the sentences of every other run with that hash are removed, whatever other runs they
are in.

A passage that is quoted from the middle of one sentence to the middle of another may hold no two whole sentences. So
runs of words join the same search, unless `passage` is None: a word is an anchor if the hash of it and the next word is the
least of some `window` such hashes in a row, and a run goes from an anchor to the first one that is MIN_WORDS words on. Where
anchors lie depends on nothing but the words around them, and no stretch of `window` words is without. With the window
that `passage` words leave room for, each passage that long holds such a run, wherever it begins in either text; of
these runs just their words are removed.

Each document sends a run once, so a group's smallest id and size are sums that Spark combines before the shuffle; runs
of very many documents are joined by broadcast. The text itself is moved once, to meet what is to be removed.

Defined results: a null text stays null, without sentences; texts with under RUN sentences or MIN_WORDS words have no runs of
sentences; in scripts without spaces between words, two characters count as a word; rows that share an id, or have none,
don't remove each other, and rows without an id are never first where another has the run; very long texts are read whole; an
empty table gives no rows; all other columns are kept, whatever they are called, but for one with the result's name.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.shared import join_splitting_hot, place, plain, restored, stage, table

RUN, MIN_WORDS = 2, 20
#: Words of a passage that is found wherever it begins.
PASSAGE = 50
#: A run's key as two numbers.
KEY = np.dtype([("h1", "<i8"), ("h2", "<i4")])
#: Bytes of text that one Arrow batch of results holds, about.
BATCH_BYTES = 16 << 20

#: Where a sentence ends, with the white space behind it.
ENDING = re.compile(r"[.!?…。！？\n](?:(?<=[.!?…])[.!?…]*[\"')\]»”’]*\s+|(?<=[。！？])[。！？]*\s*|(?<=\n)\s*)")
#: Letters and marks of scripts without spaces between words: Thai to Tibetan, Myanmar, Khmer, Chinese and Japanese.
SOLID = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fff\u3001-\u312f\u31a0-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
#: Words, which ASCII white space divides; each character of scripts without spaces is one.
WORDS, SOLID_WORDS, SOLIDS = re.compile(r"[^\t-\r ]+"), re.compile(rf"[{SOLID}]|[^\t-\r {SOLID}]+"), re.compile(rf"[{SOLID}]")


def sentences(text: str) -> list[str]:
    """Slices of text that make up all of it; each ends with the white space behind it."""
    cuts = [0, *(m.end() for m in ENDING.finditer(text)), len(text)]
    out: list[str] = []
    for a, b in zip(cuts, cuts[1:]):
        part = text[a:b]
        if not part.strip() and out:  # white space only
            out[-1] += part
        elif part:
            out.append(part)
    if len(out) > 1 and not out[0].strip():
        out[:2] = [out[0] + out[1]]
    return out


def anchors(words: list[bytes], window: int) -> np.ndarray:
    """Places of the words that, with the next one, have the least hash of some `window` places in a row."""
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    hashes = (own[:-1] ^ own[:-1] >> 15) * np.uint32(0x9E3779B1) ^ own[1:]
    if len(hashes) < window:
        return np.empty(0, np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, window).argmin(axis=1) + np.arange(len(hashes) - window + 1))


class Runs:
    """Sentences and words of a text, and its runs: key (96 bits), first and last sentence or word, and of which."""

    def __init__(self, text: str, run: int, min_words: int, passage: int | None) -> None:
        self.text, self.parts = text, sentences(text)
        self.solid = not text.isascii() and SOLIDS.search(text) is not None
        self.words: list[bytes] = []
        self.ends = [0]  # words up to each sentence
        for part in self.parts:
            low = part.lower()
            self.words += [w.encode("utf-8", "surrogatepass") for w in SOLID_WORDS.findall(low)] if self.solid else low.encode("utf-8", "surrogatepass").split()
            self.ends.append(len(self.words))
        # words so far; of characters of scripts without spaces, halves
        self.upto = np.cumsum([0, *(0.5 if SOLIDS.match(w.decode("utf-8", "surrogatepass")) else 1 for w in self.words)]) if self.solid else np.arange(len(self.words) + 1)
        self.of_sentences = self._of_sentences(run, min_words)
        self.of_words = [] if passage is None else self._of_words(min_words, max(1, (passage - 1 - min_words) // 2))

    def _key(self, a: int, b: int) -> bytes:
        return xxhash.xxh3_128_digest(b" ".join(self.words[a:b]))[:12]

    def _starts(self) -> list[int]:
        """Where each word begins in the text."""
        starts, at = [], 0
        for part in self.parts:
            starts += [at + m.start() for m in (SOLID_WORDS if self.solid else WORDS).finditer(part)]
            at += len(part)
        return starts

    def _of_sentences(self, run: int, min_words: int) -> list[tuple[bytes, int, int]]:
        """From each sentence on, as far as the text goes; the last run also goes to the end of the text."""
        out, sums = [], self.upto[self.ends].tolist()
        for k in range(len(self.parts) - run + 1):
            end = max(k + run, bisect_left(sums, sums[k] + min_words))
            if end > len(self.parts):
                break
            out.append((self._key(self.ends[k], self.ends[end]), k, end))
        if out and out[-1][2] < len(self.parts):
            k = out[-1][1]
            out.append((self._key(self.ends[k], self.ends[-1]), k, len(self.parts)))
        return out

    def _of_words(self, min_words: int, window: int) -> list[tuple[bytes, int, int]]:
        found = anchors(self.words, window)
        ends = np.searchsorted(self.upto[found], self.upto[found] + min_words)
        return [(self._key(a, b), a, b) for a, b in zip(found[ends < len(found)].tolist(), found[ends[ends < len(found)]].tolist())]

    def spans(self, repeated: set[bytes]) -> list[tuple[int, int]]:
        """Characters of repeated runs and of runs that stood earlier in the text, in order and without overlap."""
        places = np.cumsum([0, *map(len, self.parts)]).tolist()
        starts: list[int] = []
        marked = []
        for runs in (self.of_sentences, self.of_words):
            seen: set[bytes] = set()
            for key, a, b in runs:
                if key in repeated or key in seen:
                    if runs is self.of_words and not starts:
                        starts = self._starts()
                    marked.append((places[a], places[b]) if runs is self.of_sentences else (starts[a], starts[b] if b < len(starts) else len(self.text)))
                seen.add(key)
        out: list[tuple[int, int]] = []
        for a, b in sorted(marked):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


def document_runs(docs: DataFrame, id_col: str, text_col: str, run: int, min_words: int, passage: int | None) -> DataFrame:
    """id, h1 and h2 of each run of each row of docs, once for each row; one without h1 says that a run comes again in the
    row itself. part tells texts of one id apart."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, again = [], [], []
            for k, text in enumerate(batch.column("text")):
                own = Runs(text.as_py() or "", run, min_words, passage)
                distinct = dict.fromkeys(key for runs in (own.of_sentences, own.of_words) for key, _, _ in runs)
                if any(len({key for key, _, _ in runs}) < len(runs) for runs in (own.of_sentences, own.of_words)):
                    again.append(k)
                keys += distinct
                rows += [k] * len(distinct)
            halves = np.frombuffer(b"".join(keys), KEY)
            h1, h2 = (pa.concat_arrays([pa.array(np.ascontiguousarray(halves[n])), pa.nulls(len(again), kind)]) for n, kind in (("h1", pa.int64()), ("h2", pa.int32())))
            at = pa.array(rows + again, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("part").take(at), h1, h2], ["id", "part", "h1", "h2"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = plain(docs).select(F.col(place(docs, id_col)).alias("id"), F.col(place(docs, text_col)).alias("text"))
    return texts.withColumn("part", F.xxhash64("text")).mapInArrow(of, f"id {kind}, part long, h1 long, h2 int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "dedup", run: int = RUN, min_words: int = MIN_WORDS, passage: int | None = PASSAGE) -> DataFrame:
    """docs with a struct column: text (what stays), sentences, spans (start and end of what goes), first_ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    all_runs = stage(document_runs(docs, id_col, text_col, run, min_words, passage))
    runs = all_runs.where("h1 is not null")
    first = stage(runs.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    later = join_splitting_hot(runs, first, ["h1", "h2"], "n", runs.count()).where(~F.col("id").eqNullSafe(F.col("first_id")))
    again = all_runs.where("h1 is null").withColumn("first_id", F.lit(None).cast(kind))
    hashes = F.filter(F.collect_set(F.struct("h1", "h2")), lambda r: r["h1"].isNotNull())
    by_doc = later.select(again.columns).unionByName(again).groupBy(F.col("id").alias("_r_id"), F.col("part").alias("_r_part")).agg(hashes.alias("_r_runs"), F.sort_array(F.collect_set("first_id")).alias("_r_first"))
    own = plain(docs)
    same = F.col(place(docs, id_col)).eqNullSafe(F.col("_r_id")) & (F.xxhash64(place(docs, text_col)) == F.col("_r_part"))
    met = own.join(by_doc, same, "left").drop("_r_id", "_r_part")
    shape = f"text string, sentences long, spans array<struct<start:long,end:long>>, first_ids array<{kind}>"
    names = own.columns
    at_text, n = docs.columns.index(text_col), len(names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs_col, done, start, weight = batch.column(n), [], 0, 0
            firsts = batch.column(n + 1).to_pylist()
            for k, value in enumerate(batch.column(at_text)):
                text, found = value.as_py(), runs_col[k].as_py()
                spans: list[tuple[int, int]] = []
                left, count = text, 0 if text is None else len(sentences(text))
                if text is not None and found is not None:
                    spans = Runs(text, run, min_words, passage).spans({np.array((r["h1"], r["h2"]), KEY).tobytes() for r in found})
                    left = "".join(text[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)]))
                done.append({"text": left, "sentences": count, "spans": [{"start": a, "end": b} for a, b in spans], "first_ids": firsts[k] or []})
                weight += len(text or "")
                if weight >= BATCH_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(done, kinds)], [*names, "_out"])
                    done, start, weight = [], k + 1, 0

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    out = T.StructField("_out", docs.sparkSession.createDataFrame([], shape).schema)
    kinds = to_arrow_type(out.dataType)
    return restored(met.mapInArrow(of, T.StructType([*own.schema.fields, out])), docs, **{out_col: F.col("_out")})


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("dedup")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate(d["spans"], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return remove_repeats(docs).select(
        "doc_id",
        d["text"].alias("text"),
        d["sentences"].alias("n_sentences"),
        F.size(d["spans"]).alias("n_removed_spans"),
        removed.alias("removed_chars"),
        d["spans"].alias("removed_spans"),
        d["first_ids"].alias("first_ids"),
    )
