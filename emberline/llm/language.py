"""Language identification by cross-parsing against suffix automata.

Each language has one suffix automaton over labelled text. A text is parsed greedily against it: from the automaton's
start, as far as the text goes on as a substring of the training text; there a phrase ends and the next one begins.
Phrases times log2 of the training length over the text's length estimate the cross entropy in bits a byte, which
makes languages with more or less training text comparable; the language with the fewest such bits wins. A phrase is a
place in the training text or one of 256 bytes, so that a language of a few words doesn't win by cheap phrases.

The automata are dense transition tables over the byte classes that the language's own training text has, in which a
missing transition already holds the start of the next phrase and what it adds to the count. Blocks of BLOCK bytes of all
texts of a batch are parsed in lockstep against a group of languages at once, each from an automaton's start. A block is
then parsed anew from the state in which the block before it ended, until both parses are in one state, from which on
they are the same; so phrases run on over the ends of blocks, and the counts are those of the whole text parsed in one
go. Every byte of every text is parsed against every language that has a labelled row. Where the tables of all languages are more than a worker should hold, those of each
group are laid out anew for every batch.

The classifier is fitted on a bounded sample of labelled rows: for each language the whole texts with the smallest id
hashes, until they have TRAIN_BYTES bytes, from at most TRAIN_ROWS rows of at most ROW_BYTES bytes. A language that has
longer rows only is fitted on the beginning of one of them.

Defined results: a null text, or one without letters, is `und` with score 0, as are all texts without training rows;
ties go to the language first in code point order; a null id counts as empty and so as held out; repeated rows stay; an
empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.shared import place, plain, table

UNKNOWN = "und"
TRAIN_BYTES, TRAIN_ROWS, ROW_BYTES = 24_000, 64, 96_000
#: Entries of 4 bytes in the tables that a worker holds at once; a language takes about two million.
GROUP_ENTRIES = 150_000_000
BLOCK = 2048
FOLDS = 5

LETTER = re.compile(r"[^\W\d_]")
STATE = np.uint32((1 << 30) - 1)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def byte_classes(texts: list[bytes]) -> bytes:
    """Table of 256 for bytes.translate: 0 for bytes that no training text has, 1 for all that separates words, the rest a
    byte each."""
    seen = set().union(*texts)
    high = [b for b in range(128, 256) if b in seen]
    letters = [b for b in range(97, 123) if b in seen]
    out = bytearray(256)
    out[:128] = b"\1" * 128
    for b in range(97, 123):
        out[b] = 0
    for k, b in enumerate([*letters, *high]):
        out[b] = k + 2
    return bytes(out)


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(go[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go


class CrossParser:
    """Automata of all languages; what a text's parse against each costs."""

    def __init__(self, training: dict[str, list[str]]) -> None:
        joined = {lang: " ".join(texts).lower().encode("utf-8", "surrogatepass") for lang, texts in sorted(training.items())}
        self.languages = list(joined)
        self.classes = byte_classes(list(joined.values()))
        #: For each language: the column of each class, 0 for those that its own training text lacks.
        self.columns = np.zeros((len(joined), 256), np.uint8)
        self.bits: list[float] = []
        self.automata: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        for k, data in enumerate(joined.values()):
            go = suffix_automaton(data.translate(self.classes))
            column = {c: n for n, c in enumerate(sorted(go[0]), 1)}
            self.columns[k, list(column)] = list(column.values())
            at = np.array([(s, column[c], to) for s, row in enumerate(go) for c, to in row.items()], np.int32).reshape(-1, 3)
            self.automata.append((len(go), len(column) + 1, *at.T))
            self.bits.append(float(np.log2(len(data) + 256)))
        self.groups: list[tuple[int, int]] = []
        held = 0
        for k, (states, width, *_) in enumerate(self.automata):
            if not k or held + states * width > GROUP_ENTRIES:
                self.groups.append((k, k))
                held = 0
            self.groups[-1] = (self.groups[-1][0], k + 1)
            held += states * width
        self._laid: tuple[tuple[int, int], np.ndarray, np.ndarray] | None = None

    def tables(self, group: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Tables of a group of languages in one array; the start of each. A state is the place of its row."""
        if self._laid is None or self._laid[0] != group:
            self._laid = None
            automata = self.automata[slice(*group)]
            ends = np.cumsum([states * width for states, width, *_ in automata])
            table, roots = np.empty(ends[-1], np.uint32), np.concatenate(([0], ends[:-1])).astype(np.uint32)
            for base, end, (states, width, s, c, to) in zip(roots.tolist(), ends.tolist(), automata):
                own, place = table[base:end].reshape(states, width), base + to.astype(np.int64) * width
                start = np.full(width, base + (1 << 30), np.uint32)
                start[c[s == 0]] = place[s == 0]
                # from any other state a missing transition ends a phrase; a byte that the start lacks is one of its own
                own[:] = np.where(start >> np.uint32(30) > 0, np.uint32(base + (2 << 30)), start + np.uint32(1 << 30))
                own[s, c] = place
                own[0] = start
            self._laid = group, table, roots
        return self._laid[1:]

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (lower-case UTF-8) against each language."""
        codes = np.frombuffer(b"".join(texts).translate(self.classes), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        blocks = -(-sizes // BLOCK)
        of = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(sizes) - sizes)[of] + nth * BLOCK
        length = np.minimum(sizes[of] - nth * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        of, begin, length = of[order], begin[order], length[order]
        active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        total = np.zeros((len(self.languages), len(texts)), np.int64)
        # place, after sorting, of the block that follows each block in its text; -1 behind the last
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        follows = np.full(len(order), -1, np.int64)
        inner = np.flatnonzero(nth[1:] > 0)
        follows[at[inner]] = at[inner + 1]
        for group in self.groups:
            table, roots = self.tables(group)
            columns, roots = self.columns[slice(*group)], roots[:, None]
            state = np.repeat(roots, len(of), axis=1)
            count = np.zeros(state.shape, np.int64)
            for t, a in enumerate(active.tolist()):
                step = table[state[:, :a] + columns[:, codes[begin[:a] + t]]]
                count[:, :a] += step >> np.uint32(30)
                state[:, :a] = step & STATE
            self._run_on(table, columns, roots[:, 0], codes, begin, length, follows, state, count)
            count += (state != roots) & (follows < 0)
            for k, own in enumerate(count, group[0]):
                total[k] = np.bincount(of, weights=own, minlength=len(texts)).astype(np.int64)
        return total

    @staticmethod
    def _run_on(table, columns, roots, codes, begin, length, follows, state, count) -> None:  # noqa: ANN001
        """Bring end state and phrases of each block (as parsed from the start) to those of a parse that runs on from
        the block before. Both are changed in place."""
        plain_state, plain_count = state.copy(), count.copy()
        lang, before = np.nonzero((follows >= 0) & (state != roots[:, None]))
        while len(lang):
            block = follows[before]
            new, old = state[lang, before], roots[lang]
            more = np.zeros(len(lang), np.int64)
            end, here, t = plain_state[lang, block], np.arange(len(lang)), 0
            while len(here):
                k, b = lang[here], block[here]
                column = columns[k, codes[begin[b] + t]]
                one, two = table[new + column], table[old + column]
                more[here] += (one >> np.uint32(30)).astype(np.int64) - (two >> np.uint32(30))
                new, old, t = one & STATE, two & STATE, t + 1
                out = t == length[b]
                end[here[out]] = new[out]
                on = (new != old) & ~out
                here, new, old = here[on], new[on], old[on]
            count[lang, block] = plain_count[lang, block] + more
            changed = (end != state[lang, block]) & (follows[block] >= 0)
            state[lang, block] = end
            lang, before = lang[changed], block[changed]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score: 1 less the winner's bits over the next best's."""
        known = [k for k, t in enumerate(texts) if t is not None and LETTER.search(t)] if self.languages else []
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        data = [texts[k].lower().encode("utf-8", "surrogatepass") for k in known]
        if not data:
            return langs, scores
        cost = self.phrases(data) * np.array(self.bits)[:, None] / np.fromiter(map(len, data), np.float64, len(data))
        best = cost.argmin(axis=0)
        least = np.sort(cost, axis=0)
        score = np.clip(1 - least[0] / least[1], 0, 1) if len(least) > 1 else np.ones(len(data))
        for k, b, s in zip(known, best.tolist(), score.tolist()):
            langs[k], scores[k] = self.languages[b], s
        return langs, scores


#: Parsers that this worker process has built, by training text; a worker builds each once.
_built: dict[int, CrossParser] = {}


def parser_for(training: dict[str, list[str]]) -> CrossParser:
    key = hash(tuple((k, tuple(v)) for k, v in sorted(training.items())))
    if key not in _built:
        _built.clear()
        _built[key] = CrossParser(training)
    return _built[key]


def training_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Whole training texts of each language, bounded as told above; never of held-out rows."""
    rows = plain(docs).select(F.col(place(docs, id_col)).alias("id"), F.col(place(docs, text_col)).alias("text"), F.col(place(docs, lang_col)).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    spot = F.pmod(F.xxhash64(F.col("id"), F.lit("train")), F.lit(1 << 40))
    short = F.octet_length("text") <= ROW_BYTES
    counts = rows.groupBy(F.col("lang").alias("_lang")).agg(F.count_if(short).alias("_n"), F.min(F.when(short, spot)).alias("_least"), F.min(spot).alias("_long"))
    near = F.greatest(F.least(F.lit(4.0 * TRAIN_ROWS) / F.col("_n"), F.lit(1.0)) * F.lit(float(1 << 40)), F.col("_least") + 1)
    wanted = F.when(F.col("_n") > 0, short & (spot < near)).otherwise(spot == F.col("_long"))
    # one row a language: the model that every worker holds has an automaton for each
    few = rows.join(F.broadcast(counts), F.col("lang") == F.col("_lang")).where(wanted)
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy("_place", "_text"))
    few = few.select("_lang", spot.alias("_place"), F.when(short, F.col("text")).otherwise(F.substring("text", 1, TRAIN_BYTES)).alias("_text")).withColumn("_nth", nth).where(F.col("_nth") <= TRAIN_ROWS)
    so_far = F.sum(F.octet_length("_text")).over(Window.partitionBy("_lang").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1))
    chosen = few.withColumn("_before", F.coalesce(so_far, F.lit(0))).where(F.col("_before") < TRAIN_BYTES).orderBy("_lang", "_nth").collect()
    out: dict[str, list[str]] = {}
    for r in chosen:
        out.setdefault(r["_lang"], []).append(r["_text"])
    return out


def identify(docs: DataFrame, training: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score of each row of docs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_for(training)
        for batch in batches:
            langs, scores = parser.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = plain(docs).select(F.col(place(docs, id_col)).alias("id"), held_out(place(docs, id_col)).alias("held_out"), F.col(place(docs, text_col)).alias("text"))
    return rows.mapInArrow(of, f"id {kind}, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, training_texts(docs)).withColumnRenamed("id", "doc_id")
