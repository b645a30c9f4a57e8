"""Best-fit packing of token sequences by hierarchical residuals.

Partitions pack their own pieces best-fit (longest first) and keep the bins that are nearly
full.  Underfull bins go on as items: groups of partitions merge, and best-fit runs again over
the bins, until a round has one group or no longer helps.  No task ever holds more than a
partition of pieces or GROUP_ITEMS underfull bins.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import kernels
from sparkloom.llm.common import Workspace, table

CAPACITY = 4096
#: A bin with at most this many tokens free is nearly full and is emitted.
SLACK = 8
#: Underfull bins that one task of a later round packs, at most.
GROUP_ITEMS = 100_000
#: Partitions whose underfull bins merge into one group.
FAN_IN = 8
#: The id that ends every document.
END = 1
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 1_000_000
TABLE = 1 << 21
_SLOT = np.uint64(TABLE - 1)


#: The parts of a tokenizer whose ids may be looked up by words.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(rules: dict) -> bool:
    """Whether a tokenizer (its JSON) normalises, splits and closes words as ``WordIds`` takes for granted."""
    normalizers = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers", [])]
    splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = rules.get("model") or {}
    return (
        normalizers == NORMALIZERS and [x.get("type") for x in splits] == ["Split", "ByteLevel"] and splits[0].get("pattern") == {"Regex": SPLIT} and splits[0].get("invert") is True
        and splits[1].get("add_prefix_space") is False and splits[1].get("use_regex") is False and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and rules.get("post_processor") is None and rules.get("truncation") is None and all(t["content"].startswith("<|") for t in rules.get("added_tokens") or [])
    )


class TextIds:
    """Token ids of whole texts, by any tokenizer."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed with END; offsets of the texts in them)."""
        raw = data.tobytes()
        found = [[*e.ids, END] for e in self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.cumsum([0, *map(len, found)])


_loaded: dict[str, WordIds | TextIds] = {}


def encoder(path: str) -> WordIds | TextIds:
    """The encoder of a tokenizer file, which lives as long as the worker: by words where its rules allow it."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            fits = by_words(json.load(f))
        _loaded[path] = (WordIds if fits else TextIds)(path)
    return _loaded[path]


class WordIds:
    """Token ids by words, each met word encoded once and then looked up.

    A tokenizer of the rules of ``by_words`` never joins text over white space, nor a letter with the stop or
    comma that ends a word, and it lowers case; so the ids of a text are those of its lowered words
    and such stops one after another.  Words are known by 64-bit hashes in an open table that lives
    as long as the worker; when CACHE_WORDS are in it, later ones are encoded anew in every batch.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.keys = np.zeros(TABLE, np.uint64)  # 0: free
        self.entries = np.zeros(TABLE, np.int32)
        self.flat = np.zeros(1 << 20, np.uint32)
        self.flat[0] = END
        self.bounds = np.array([0, 1], np.int64)  # entry 0 is END

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many each word has, the places of the words in that order)."""
        whole = np.fromiter((w.isalpha() and (w.isascii() or w.lower() == w and unicodedata.is_normalized("NFC", w)) for w in words), bool, len(words))
        one, rest = np.flatnonzero(whole), np.flatnonzero(~whole)
        ids = ends = np.zeros(0, np.int64)
        if len(one):  # one pre-token each, so one closing token each: they can go as one text
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join([words[i] for i in one])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(one):
                one, rest, ids, ends = one[:0], np.arange(len(words)), ids[:0], ends[:0]
        each = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)] if len(rest) else []
        counts = np.concatenate((np.diff(ends, prepend=0), np.array([len(x) for x in each], np.int64)))
        return np.concatenate((ids, np.fromiter(chain.from_iterable(each), np.int64))).astype(np.uint32), counts, np.concatenate((one, rest))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        left, slot = np.arange(len(hashes)), (hashes & _SLOT).astype(np.int64)
        while len(left):
            key = self.keys[slot]
            hit = key == hashes[left]
            out[left[hit]] = self.entries[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) & (TABLE - 1)
        return out

    def _store(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        slot = (hashes & _SLOT).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.keys[slot] == 0)
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[put]], self.entries[slot[put]] = hashes[put], entries[put]
            on = np.ones(len(hashes), bool)
            on[put] = False
            hashes, entries, slot = hashes[on], entries[on], (slot[on] + 1) & (TABLE - 1)

    def _learn(self, words: list[str]) -> np.ndarray:
        """New entries for words, in their order."""
        ids, counts, order = self._encode(words)
        end = int(self.bounds[-1])
        while end + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[end : end + len(ids)] = ids
        entries = np.zeros(len(words), np.int64)
        entries[order] = np.arange(len(self.bounds) - 1, len(self.bounds) - 1 + len(words))
        self.bounds = np.concatenate((self.bounds, end + np.cumsum(counts)))
        return entries

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed with END; offsets of the texts in them)."""
        lowered = kernels.LOWER[data]
        if b"<|" in (raw := data.tobytes()):  # special tokens are told from text by case
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if b"<|" in raw[a:b]:
                    lowered[a:b] = data[a:b]
        starts, ends, _ = kernels.words(lowered, offsets)
        last = lowered[ends - 1] if len(ends) else lowered[:0]
        stop = np.flatnonzero((ends - starts > 1) & ((last == 46) | (last == 44)) & (np.abs(lowered[ends - 2].astype(np.int16) * 2 - 219) <= 25)) if len(ends) else np.zeros(0, np.int64)
        starts = np.insert(starts, stop + 1, ends[stop] - 1)
        ends = np.insert(ends, stop, ends[stop] - 1)
        hashes = kernels.span_hashes(lowered, starts, ends) | np.uint64(1)
        entry = self._find(hashes)
        known, keep = len(self.bounds), True
        new = np.flatnonzero(entry < 0)
        if len(new):
            unique, first, again = np.unique(hashes[new], return_index=True, return_inverse=True)
            raw = lowered.tobytes()
            learned = self._learn([raw[starts[i] : ends[i]].decode() for i in new[first]])
            entry[new] = learned[again]
            if keep := known + len(unique) <= CACHE_WORDS:
                self._store(unique, learned)
        text_at = np.searchsorted(starts, offsets)  # words before each text
        entry = np.insert(entry, text_at[1:], 0)
        begin = self.bounds[entry]
        lengths = self.bounds[entry + 1] - begin
        shift = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        ids = self.flat[np.arange(total) + np.repeat(begin - shift, lengths)].astype("<u4")
        text_at = text_at + np.arange(len(text_at))
        out = np.append(shift, total)[text_at]
        if not keep:
            self.bounds = self.bounds[:known]
        return ids, out


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids with END after them, cut into pieces of ``capacity`` where it is longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            ids_of = batch.column(0).to_pylist()
            for row, _, data, offsets in kernels.pieces(batch.column(1)):
                ids, bounds = encode(data, offsets)
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), row):
                    for n, at in enumerate(range(a, b, capacity)):
                        part = ids[at : min(b, at + capacity)]
                        rows.append((ids_of[k], n, at - a, len(part), zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset in it, tokens in each bin): best fit, longest items first.

    Open bins stand by their free tokens; the set of free sizes in use is the bits of one integer,
    so the tightest bin for an item is the lowest bit from the item's length on.
    """
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, count = 0, 0
    place = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = used >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = open_[free].pop()
            if not open_[free]:
                used &= ~(1 << free)
        else:
            free, b = capacity, count
            count += 1
            fill.append(0)
        place[i], offset[i] = b, fill[b]
        fill[b] += n
        rest = free - n
        open_[rest].append(b)
        used |= 1 << rest
    return place, offset, np.asarray(fill, np.int64)


def _pack_partition(level: int, capacity: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        place, offset, fill = best_fit(rows["length"].to_numpy(), capacity)
        first = (level << 56) | (TaskContext.get().partitionId() << 32)
        out = rows.select(columns).append_column("bin", pa.array(first + place)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill[place]))
        yield from out.to_batches(max_chunksize=100_000)

    return run


def pack(spark: SparkSession, items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """``items`` (with a ``length`` of 0 to ``capacity``) with ``sequence_id`` and ``offset``.

    Columns named bin, fill, sequence_id or offset are replaced.  Which item lands where follows
    the partitions; the written rounds make it one fixed answer for a call.
    """
    work = Workspace(spark, "packing")
    items = items.drop("bin", "fill", "sequence_id", "offset")
    kinds = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    packed = work.save(items.mapInArrow(_pack_partition(1, capacity, items.columns), f"{kinds}, bin bigint, offset bigint, fill bigint"), "round1")
    rounds: list[DataFrame] = []
    under = packed.filter((F.col("fill") < capacity - slack) & (F.col("offset") == 0)).select("bin", F.col("fill").alias("length"))
    groups = max(1, packed.rdd.getNumPartitions())
    level = 1
    while True:
        n = under.count()
        groups = max(-(-groups // FAN_IN), -(-n // GROUP_ITEMS), 1)
        if n < 2:
            break
        level += 1
        merged = under.repartition(groups, F.col("bin")).withColumnRenamed("bin", "item").mapInArrow(_pack_partition(level, capacity, ["item", "length"]), "item bigint, length bigint, bin bigint, offset bigint, fill bigint")
        merged = work.save(merged, f"round{level}")
        rounds.append(merged.select("item", F.col("bin").alias(f"b{level}"), F.col("offset").alias(f"o{level}")))
        under = merged.filter((F.col("fill") < capacity - slack) & (F.col("offset") == 0)).select("bin", F.col("fill").alias("length"))
        if groups == 1 or (left := under.count()) == n and groups <= -(-left // GROUP_ITEMS):
            break
    sequence, offset, out = F.col("bin"), F.col("offset"), packed
    if rounds:  # only rows of underfull bins look for a later bin; what bins became is small beside the pieces
        chain = rounds[0].select(F.col("item").alias("first"), F.col("b2").alias("last"), F.col("o2").alias("moved"))
        for k, r in enumerate(rounds[1:], 3):
            chain = chain.join(r, chain["last"] == r["item"], "left").select("first", F.coalesce(f"b{k}", "last").alias("last"), (F.col("moved") + F.coalesce(f"o{k}", F.lit(0))).alias("moved"))
        out = packed.join(chain, packed["bin"] == chain["first"], "left")
        sequence, offset = F.coalesce("last", "bin"), F.col("offset") + F.coalesce("moved", F.lit(0))
    return out.select(*[F.col(c) for c in items.columns], sequence.alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with their places in sequences.

    Null and empty texts are one piece, END alone; very long ones are encoded whole; rows that repeat
    are packed each; no documents give no rows.  Other columns are not read.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    cut = Workspace(spark, "pieces").save(pieces(docs, str(path), capacity), "pieces")
    return pack(spark, cut, capacity)


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text of ``documents`` at its place in a sequence; see ``pack_documents``."""
    return pack_documents(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
