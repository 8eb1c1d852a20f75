"""Phrase collocations, counted in HAT-tries.

A task turns its words into numbers and counts phrases of up to three words in a trie over word numbers.
The trie is shallow: its leaves are hash containers, each for a range of first words (of second words
below a first word that has a container to itself). A container that outgrows its bound bursts into two, at
a word's edge. When a task holds more entries than its bound, the largest subtrees are spilled whole, each
as a run in the order of its first words, and the rest stays. Spark deals the runs out by prefix: the first
word and a sixteenth of the second words, so that a word that begins a third of all phrases is spread over
its successors. Each partition merges its sorted runs in one pass and passes on what is frequent.

What follows concerns phrases above the frequency bound alone: the parts of such a phrase are as frequent,
so one table of frequent phrases is joined with itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.sequences import top_n_per_group
from colloquy.session import use_utc, written_table

# What ends a piece, what separates words, the name of a missing language.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
UNKNOWN = "und"
MARK = b"\xff"  # in no UTF-8 text
BITS = 21
WORD_MASK = (1 << BITS) - 1
EMPTY = -1
MAX_ENTRIES = 2_500_000
BURST = 1 << 17
SLOTS = 16
CHUNK_WORDS = 300_000
CHUNK_BYTES = 1 << 20
RUN_ROWS = 50_000
_FOLD = bytes(MARK[0] if b in BREAKS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: str, chunk: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Words of a text in lower case (A-Z only), with a mark where a piece ends, a chunk at a time."""
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    start = 0
    while start < len(folded):
        end = folded.find(b" ", start + chunk)
        end = len(folded) if end < 0 else end
        yield folded[start:end].replace(MARK, b" \xff ").split()
        start = end


class WordIds(dict):
    """Numbers words as they come; a piece's end is 0."""

    def __init__(self) -> None:
        super().__init__({MARK: 0})
        self.words = [MARK]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


class Container:
    """A hash table with open addressing from packed phrases to counts; whole batches are added at once."""

    def __init__(self, room: int) -> None:
        self.bits = max(4, (2 * room - 1).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY, dtype=np.int64)
        self.counts = np.zeros(1 << self.bits, dtype=np.int64)
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct keys with their counts."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            held, numbers = self.entries()
            self.__init__(2 * (self.size + len(keys)))
            self._put(held, numbers)
        self._put(keys, counts)

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            found = self.keys[slots]
            free = found == EMPTY
            self.keys[slots[free]] = keys[free]  # of several that want a slot the last one has it
            settled = self.keys[slots] == keys
            self.size += int((settled & free).sum())
            self.counts[slots[settled]] += counts[settled]
            left = ~settled
            keys, counts, slots = keys[left], counts[left], (slots[left] + 1) & (len(self.keys) - 1)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        used = np.flatnonzero(self.keys != EMPTY)
        return self.keys[used], self.counts[used]


class HatTrie:
    """Counts of word sequences of one to three numbers, packed into one; 0 stands for no word.

    ``bounds[k]`` is the least packed sequence of the k-th container.
    """

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        self.bounds = [0]
        self.containers = [Container(1)]

    @property
    def entries(self) -> int:
        return sum(c.size for c in self.containers)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Packed sequences, distinct and in order, with their counts."""
        cuts = [*np.searchsorted(keys, self.bounds).tolist(), len(keys)]
        for k in reversed(range(len(self.containers))):
            if cuts[k + 1] > cuts[k]:
                self.containers[k].add(keys[cuts[k]:cuts[k + 1]], counts[cuts[k]:cuts[k + 1]])
                if self.containers[k].size > self.burst:
                    self._split(k)

    def _split(self, k: int) -> None:
        """Burst a container until its parts are within the bound, at the edge of a first, second or third word."""
        keys, counts = self.containers[k].entries()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        starts, pending = [], [(0, len(keys))]
        while pending:
            low, high = pending.pop()
            if high - low <= self.burst:
                starts.append(low)
                continue
            middle = int(keys[(low + high) // 2])
            for shift in (2 * BITS, BITS, 0):
                cut = low + int(np.searchsorted(keys[low:high], middle >> shift << shift))
                if cut > low:
                    break
            pending += [(low, cut), (cut, high)]
        starts.sort()
        parts, bounds = [], []
        for low, high in zip(starts, [*starts[1:], len(keys)]):
            parts.append(Container(high - low))
            parts[-1].add(keys[low:high], counts[low:high])
            bounds.append(int(keys[low]))
        bounds[0] = self.bounds[k]
        self.containers[k:k + 1], self.bounds[k:k + 1] = parts, bounds

    def take(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Remove whole subtrees, the largest first, until ``keep`` entries are left; packed sequences, counts."""
        taken = []
        left = self.entries
        for k in sorted(range(len(self.containers)), key=lambda k: -self.containers[k].size):
            if left <= keep:
                break
            left -= self.containers[k].size
            taken.append(self.containers[k].entries())
            self.containers[k] = Container(1)
        if not taken:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([k for k, _ in taken]), np.concatenate([n for _, n in taken])


class _Counter:
    """The tries of a task, one per language, under one bound of entries."""

    def __init__(self, max_entries: int, burst: int) -> None:
        self.max_entries, self.burst = max_entries, burst
        self.ids = WordIds()
        self.tries: dict[str, HatTrie] = {}
        self.waiting: dict[str, list[int]] = {}
        self.held = 0
        self.totals: dict[str, int] = {}

    def text(self, language: str, text: str) -> Iterator[pa.RecordBatch]:
        carried: list[bytes] = []
        for part in tokens(text):
            # A chunk's last two words begin no phrase in it: they begin the next chunk, or stand alone at the end.
            found = carried + part
            carried = found[-2:]
            self._wait(language, found, len(carried))
            if self.held >= CHUNK_WORDS:
                yield from self.count()
        self._wait(language, carried, 0)

    def _wait(self, language: str, words: list[bytes], silent: int) -> None:
        waiting = self.waiting.setdefault(language, [])
        waiting.extend(map(self.ids.__getitem__, words))
        waiting.extend((0, -silent, 0))
        self.held += len(words)

    def count(self) -> Iterator[pa.RecordBatch]:
        for language, numbers in self.waiting.items():
            words = np.array(numbers, dtype=np.int64)
            # A negative number n says that the last n words before it begin no phrase.
            starting = words > 0
            for place in np.flatnonzero(words < 0).tolist():
                starting[place - 1 + words[place]:place] = False
            words[words < 0] = 0
            padded = np.concatenate((words, [0, 0]))
            one, two, three = words, padded[1:-1], padded[2:]
            pair = starting & (two > 0)
            triple = pair & (three > 0)
            head = one << (2 * BITS)
            keys = np.concatenate((head[starting], (head | (two << BITS))[pair], (head | (two << BITS) | three)[triple]))
            if len(keys):
                self.totals[language] = self.totals.get(language, 0) + int(starting.sum())
                self.tries.setdefault(language, HatTrie(self.burst)).add(*np.unique(keys, return_counts=True))
        self.waiting, self.held = {}, 0
        if len(self.ids.words) > WORD_MASK // 2:
            yield from self.spill(0)
            self.ids = WordIds()
        elif sum(t.entries for t in self.tries.values()) > self.max_entries:
            yield from self.spill(self.max_entries // 4)

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Whole subtrees until ``keep`` entries are left, as runs in the order of their prefixes."""
        held = max(1, sum(t.entries for t in self.tries.values()))
        vocabulary = pa.array(self.ids.words, pa.binary())
        rank = np.zeros(len(vocabulary), dtype=np.int64)
        rank[pc.array_sort_indices(vocabulary[1:]).to_numpy() + 1] = np.arange(1, len(vocabulary))
        slot = np.array([zlib.crc32(w) % SLOTS for w in self.ids.words], dtype=np.int64)
        slot[0] = 0
        for language, trie in self.tries.items():
            keys, counts = trie.take(keep * trie.entries // held)
            if not len(keys):
                continue
            two = keys >> BITS & WORD_MASK
            order = np.argsort((rank[keys >> (2 * BITS)] * SLOTS + slot[two]) << BITS | rank[two])
            keys, counts, two = keys[order], counts[order], two[order]
            prefix = (keys >> (2 * BITS)) * SLOTS + slot[two]
            starts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            bounds = [*range(0, len(starts), RUN_ROWS), len(starts)]
            for low, high in zip(bounds, bounds[1:]):
                first, end = starts[low], starts[high] if high < len(starts) else len(keys)
                yield _run(language, vocabulary, prefix[starts[low:high]], starts[low:high] - first, keys[first:end], counts[first:end])

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self.count()
        yield from self.spill(0)
        for language, total in self.totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([language]), pa.array([b""]), pa.array([0], pa.int32()), pa.array([b""]), _packed(np.array([total]), np.array([0]))], RUN_COLUMNS
            )


RUN = "lang string, _prefix binary, _slot int, _tails binary, _counts binary"
RUN_COLUMNS = [part.split()[0] for part in RUN.split(", ")]


def _packed(counts: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary value per row: its counts in as many bytes each (1, 2, 4 or 8) as the largest one needs."""
    most = np.maximum.reduceat(counts, starts)
    sizes = np.diff(np.concatenate((starts, [len(counts)])))
    widths = 1 << np.searchsorted([1 << 8, 1 << 16, 1 << 32], most, side="right")
    ends = np.cumsum(sizes * widths)
    width, place = np.repeat(widths, sizes), _places(ends - sizes * widths, sizes, widths)
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    for w in np.unique(widths).tolist():
        own = width == w
        out[place[own][:, None] + np.arange(w)] = counts[own].astype(f"<u{w}").view(np.uint8).reshape(-1, w)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def _places(first: np.ndarray, sizes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Byte at which every count of every row begins."""
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(first, sizes) + inside * np.repeat(widths, sizes)


def _unpacked(column: pa.ChunkedArray, sizes: np.ndarray) -> np.ndarray:
    """The counts of all rows, of which each has so many as ``sizes`` says."""
    lengths = pc.binary_length(column).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    widths = lengths // sizes
    width, place = np.repeat(widths, sizes), _places(np.cumsum(lengths) - lengths, sizes, widths)
    out = np.empty(len(place), dtype=np.int64)
    for w in np.unique(widths).tolist():
        own = width == w
        out[own] = data[place[own][:, None] + np.arange(w)].view(f"<u{w}").ravel()
    return out


def _run(language: str, vocabulary: pa.Array, prefix: np.ndarray, starts: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row per prefix: the phrases below it, less their first words, by line ends, and their counts."""
    two, three = keys >> BITS & WORD_MASK, keys & WORD_MASK
    second = pc.if_else(pa.array(two == 0), pa.scalar(b"", pa.binary()), vocabulary.take(pa.array(two)))
    blank = pa.scalar(b" ", pa.binary())
    tails = second
    longer = np.flatnonzero(three)
    if len(longer):
        joined = pc.binary_join_element_wise(second.take(pa.array(longer)), vocabulary.take(pa.array(three[longer])), blank)
        tails = pc.replace_with_mask(second, pa.array(three > 0), joined)
    ends = np.concatenate((starts, [len(keys)]))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tails)
    names = pa.array([language], pa.string()).take(pa.array(np.zeros(len(starts), dtype=np.int32)))
    return pa.RecordBatch.from_arrays(
        [names, vocabulary.take(pa.array(prefix // SLOTS)), pa.array((prefix % SLOTS).astype(np.int32)),
         pc.binary_join(lists, pa.scalar(b"\n", pa.binary())), _packed(counts, starts)], RUN_COLUMNS,
    )


def _merge(min_count: int):
    """Merges rows in the order of their prefixes; rows of one prefix come from different runs."""

    def folded(rows: pa.Table) -> pa.RecordBatch:
        tails = pc.split_pattern(rows.column("_tails").combine_chunks(), b"\n")
        sizes = pc.list_value_length(tails).to_numpy().astype(np.int64)
        counts, parents = _unpacked(rows.column("_counts"), sizes), np.repeat(np.arange(rows.num_rows), sizes)
        group = rows.column("_group").to_numpy()
        several = np.bincount(group, minlength=group[-1] + 1)[group] > 1
        flat = tails.flatten()
        again = several[parents]
        table = pa.table({"g": pa.array(group[parents[again]]), "t": flat.filter(pa.array(again)), "n": pa.array(counts[again])})
        summed = table.group_by(["g", "t"], use_threads=False).aggregate([("n", "sum")])
        first_of = np.searchsorted(group, np.arange(group[-1] + 1))
        total = pc.equal(pc.binary_length(rows.column("_prefix")), 0).to_numpy()
        kept = np.flatnonzero(~again & ((counts >= min_count) | total[parents]))
        enough = (summed.column("n_sum").to_numpy() >= min_count) | total[first_of[summed.column("g").to_numpy()]]
        merged = summed.filter(pa.array(enough))
        row = np.concatenate((parents[kept], first_of[merged.column("g").to_numpy()])).astype(np.int64)
        tail = pa.chunked_array([flat.take(pa.array(kept)), *merged.column("t").chunks], pa.binary()).combine_chunks()
        prefix = rows.column("_prefix").combine_chunks().take(pa.array(row))
        alone = pc.equal(pc.binary_length(tail), 0)
        phrase = pc.if_else(alone, prefix, pc.binary_join_element_wise(prefix, tail, pa.scalar(b" ", pa.binary())))
        words = np.where(alone.to_numpy(zero_copy_only=False), pc.binary_length(prefix).to_numpy() > 0, 2 + pc.count_substring(tail, b" ").to_numpy())
        return pa.RecordBatch.from_arrays(
            [rows.column("lang").combine_chunks().take(pa.array(row)), phrase.cast(pa.string()), pa.array(words.astype(np.int32)),
             pa.array(np.concatenate((counts[kept], merged.column("n_sum").to_numpy())))],
            ["lang", "phrase", "words", "f"],
        )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            if not rows.num_rows:
                continue
            new = np.zeros(rows.num_rows, dtype=bool)
            for name in ("lang", "_prefix", "_slot"):
                column = rows.column(name).combine_chunks()
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(new)[-1]) if new.any() else 0
            waiting = rows.slice(last)
            if last:
                yield folded(rows.slice(0, last).append_column("_group", pa.array(np.cumsum(new)[:last])))
        if waiting is not None and waiting.num_rows:
            yield folded(waiting.append_column("_group", pa.array(np.zeros(waiting.num_rows, dtype=np.int64))))

    return merged


def phrase_counts(df: DataFrame, text_column: str = "text", language_column: str = "lang", min_count: int = 1,
                  max_entries: int = MAX_ENTRIES, burst: int = BURST) -> DataFrame:
    """``lang``, ``phrase``, ``words`` and ``f`` of every phrase of one to three words met ``min_count`` times or more.

    One more row per language, with an empty phrase of 0 words, counts all word occurrences.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(max_entries, burst)
        for batch in batches:
            for language, text in zip(batch.column(0), batch.column(1)):
                yield from counter.text(language.as_py(), text.as_py())
        yield from counter.rest()

    rows = df.select(
        F.coalesce(F.col(f"`{language_column}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )
    keys = ["lang", "_prefix", "_slot"]
    runs = rows.mapInArrow(counted, RUN).repartition(*keys).sortWithinPartitions(*keys)
    return runs.mapInArrow(_merge(min_count), "lang string, phrase string, words int, f long")


def _exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)); the products are decimals of 38 digits."""
    wide = [c.cast("decimal(16,0)") for c in (a, left, right)]
    product = wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", product.cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(38,0)"))


def collocations(df: DataFrame, text_column: str = "text", language_column: str = "lang", min_count: int = 10,
                 top: int = 2000, inside_percent: int = 50, max_entries: int = MAX_ENTRIES, burst: int = BURST) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of two or three words that occur ``min_count`` times or more; a candidate's
    score is that of its weakest cut. A pair that lies in a candidate of three words which has
    ``inside_percent`` of its occurrences or more is left out. Missing texts are empty, a missing language
    is ``und``; empty texts and texts of separators have no words; repeated rows count each time; texts
    of any length are read in chunks and phrases across the cut are counted; equal scores go by
    occurrences, then by phrase in byte order. An empty table gives an empty table. Counts must be
    below 10^16. Other columns are not read.
    """
    use_utc(df.sparkSession)
    counts = phrase_counts(df, text_column, language_column, min_count, max_entries, burst)
    frequent = written_table(counts, "phrases")

    def part(words: int, key: str, name: str) -> DataFrame:
        rows = frequent.filter(F.col("words") == words)
        return rows.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))

    def cut(k: int) -> Column:
        return F.struct(_exact_score(F.col("a"), F.col(f"_l{k}"), F.col(f"_r{k}")).alias("score"), F.lit(k).alias("k"),
                        F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r"))

    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    head, tail = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)
    pairs = frequent.filter("words = 2").select("lang", "phrase", F.col("f").alias("a"), first.alias("_w1"), last.alias("_w2"))
    pairs = pairs.join(part(1, "_w1", "_l1"), ["lang", "_w1"]).join(part(1, "_w2", "_r1"), ["lang", "_w2"])
    triples = written_table(
        frequent.filter("words = 3").select(
            "lang", "phrase", F.col("f").alias("a"), first.alias("_w1"), last.alias("_w3"), head.alias("_head"), tail.alias("_tail")
        ),
        "phrases-of-three",
    )
    inside = triples.select("lang", "a", F.explode(F.array("_head", "_tail")).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = pairs.join(inside, ["lang", "phrase"], "left").filter(
        F.col("_longer").isNull() | (100 * F.col("_longer") < inside_percent * F.col("a"))
    )
    scored = kept.select("lang", "phrase", "a", cut(1).alias("_cut"))
    whole = (
        triples.join(part(2, "_head", "_l2"), ["lang", "_head"]).join(part(2, "_tail", "_r1"), ["lang", "_tail"])
        .join(part(1, "_w1", "_l1"), ["lang", "_w1"]).join(part(1, "_w3", "_r2"), ["lang", "_w3"])
    )
    scored = scored.unionByName(whole.select("lang", "phrase", "a", F.least(cut(1), cut(2)).alias("_cut")))
    rows = scored.select("lang", "phrase", "a", "_cut.l", "_cut.r", F.col("_cut.score").cast("long").alias("score"))
    ranked = top_n_per_group(
        rows, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top, ["phrase", "a", "l", "r", "score"]
    )
    totals = frequent.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("_rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
