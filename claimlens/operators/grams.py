"""N-grams counted inside tasks, in Arrow batches of token lists.

Spark deals the texts out by id and cuts their tokens; a task numbers the different words of a slice, counts
n-grams as pairs of numbers, and gives strings to the different ones alone.  Counting each n-gram as a row of its
own (explode and two hash aggregates) takes several times as long.  Character n-grams are cut once for each
different word of a slice; a row's counts are sums over its words.

Rows come sorted by key, so an id's rows lie together; the last id of a slice is held back
until the next one, since its rows may go on there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that are held as numbers at once (a longer text makes a slice of its own).
SLICE_TOKENS = 500_000
#: Words that are held at once where their characters are counted: each has some twenty n-grams.
SLICE_WORDS = 100_000
#: Terms in one row that a task gives back.
LIST_TERMS = 100_000
#: Pieces of a held id that are kept before they are added up.
HELD_PIECES = 32

#: Takes the groups' keys and ids' numbers, the terms, and of each entry its group, its term's place and the count.
Sink = Callable[[list, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]


def entries(flat: pa.Array, text: np.ndarray, group: np.ndarray, ngram_range: tuple[int, int],
            among: pa.Array | None, between: str = " ") -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, group, place among the terms, count) of the n-grams of the tokens ``flat``, whose texts and groups are numbered."""
    lo, hi = ngram_range
    coded = flat.dictionary_encode()
    words, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    terms, code, at = words, word, np.arange(len(word))
    found, parts, first = [], [], 0
    for n in range(1, hi + 1):
        if n > 1:
            # an n-gram is an (n-1)-gram and the word after it, in the same text
            inside = at + n - 1 < len(word)
            at, code = at[inside], code[inside]
            inside = text[at + n - 1] == text[at]
            at, code = at[inside], code[inside]
            pairs, code = np.unique(code * len(words) + word[at + n - 1], return_inverse=True)
            if not len(pairs):
                break
            terms = pc.binary_join_element_wise(terms.take(pa.array(pairs // len(words))), words.take(pa.array(pairs % len(words))), between)
        if n < lo or not len(at):
            continue
        g, c = group[at], code
        if among is not None:
            wanted = pc.is_in(terms, value_set=among).to_numpy(zero_copy_only=False)[c]
            g, c = g[wanted], c[wanted]
        entry, count = np.unique(g * len(terms) + c, return_counts=True)
        found.append(terms)
        parts.append((entry // len(terms), entry % len(terms) + first, count))
        first += len(terms)
    if not parts:
        return words[:0], *[np.zeros(0, np.int64)] * 3
    return pa.concat_arrays(found), *[np.concatenate(x) for x in zip(*parts)]


def char_entries(flat: pa.Array, text: np.ndarray, group: np.ndarray, ngram_range: tuple[int, int],
                 among: pa.Array | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``entries`` of the n-grams inside the words ``flat``, each padded with one space on each side."""
    coded = flat.dictionary_encode()
    words, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(words):
        return words, *[np.zeros(0, np.int64)] * 3
    codes, code = np.unique(np.frombuffer((" " + "  ".join(words.to_pylist()) + " ").encode("utf-32-le"), dtype="<u4"), return_inverse=True)
    letters = pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), pa.array([chr(c) for c in codes], pa.string()))
    of_letter = np.repeat(np.arange(len(words)), pc.utf8_length(words).to_numpy(zero_copy_only=False) + 2)
    terms, of_word, place, inside = entries(letters, of_letter, of_letter, ngram_range, among, "")
    order = np.argsort(of_word, kind="stable")
    place, inside = place[order], inside[order]
    sizes = np.bincount(of_word, minlength=len(words))
    first = np.cumsum(sizes) - sizes
    pair, times = np.unique(group * len(words) + word, return_counts=True)
    of_group, of_pair = pair // len(words), pair % len(words)
    # every n-gram of every different word of a group
    n = sizes[of_pair]
    at = np.arange(n.sum()) + np.repeat(first[of_pair] - (np.cumsum(n) - n), n)
    if not len(at):
        return terms[:0], *[np.zeros(0, np.int64)] * 3
    key = np.repeat(of_group, n) * len(terms) + place[at]
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.add.reduceat((np.repeat(times, n) * inside[at])[order], starts)
    return terms, key[starts] // len(terms), key[starts] % len(terms), count


def groups(keys: list[pa.Array]) -> np.ndarray:
    """The number of each row's group: one more where a row's key differs from that of the row before."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        a, b = k[1:], k[:-1]
        new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) \
            | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.cumsum(new)


class Held:
    """The counts of one id whose rows may go on."""

    def __init__(self, key: pa.Array, names: list[str]):
        self.key, self.names, self.pieces = key, names, []

    def add(self, own: list, terms: pa.Array, g: np.ndarray, c: np.ndarray, n: np.ndarray) -> None:
        at = pa.array(g)
        self.pieces.append(pa.table([*(k.take(at) for k in own), terms.take(pa.array(c)), pa.array(n, pa.int64())], names=[*self.names, "_term", "_n"]))
        if len(self.pieces) > HELD_PIECES:
            self.pieces = [self.total()]

    def total(self) -> pa.Table:
        t = pa.concat_tables(self.pieces).group_by([*self.names, "_term"]).aggregate([("_n", "sum")])
        return t.select([*self.names, "_term", "_n_sum"]).rename_columns([*self.names, "_term", "_n"])

    def given(self, sink: Sink) -> Iterator[pa.RecordBatch]:
        for b in (self.total() if len(self.pieces) > 1 else self.pieces[0]).combine_chunks().to_batches():
            at = np.arange(b.num_rows)
            yield sink(b.columns[:-2], np.zeros(len(at), np.int64), b.column(b.num_columns - 2), at, at, b.column(b.num_columns - 1).to_numpy())


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` tokens, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(a, b - a)
            a = b


def counting(ngram_range: tuple[int, int], sink: Sink, among=None, chars: bool = False):
    """For ``mapInArrow`` over (keys..., tokens), sorted by the keys, the first of which is the id that rows are dealt out by.
    With ``chars`` the tokens are words and the n-grams those of their characters."""
    cut, size = (char_entries, SLICE_WORDS) if chars else (entries, SLICE_TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if among is None else among.value[0]
        held: Held | None = None
        for batch in slices(batches, size):
            keys, lists = [batch.column(i) for i in range(batch.num_columns - 1)], batch.column(batch.num_columns - 1)
            of_row = groups(keys)
            text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            own = [k.take(pa.array(np.flatnonzero(np.diff(of_row, prepend=-1)))) for k in keys]   # one row a group
            of_group = groups(own[:1])   # the id's number
            terms, g, c, n = cut(lists.flatten(), text, of_row[text], ngram_range, wanted)
            of_entry, last = of_group[g], of_group[-1]
            goes_on = held is not None and not groups([pa.concat_arrays([held.key, own[0][:1]])])[-1]
            if held is not None and not goes_on:
                yield from held.given(sink)
            if goes_on:
                first = of_entry == 0
                held.add(own, terms, g[first], c[first], n[first])
                if last:
                    yield from held.given(sink)
            if last or not goes_on:
                held, ends = Held(own[0][-1:], batch.schema.names[:-1]), of_entry == last
                held.add(own, terms, g[ends], c[ends], n[ends])
            inner = (of_entry != last) & ((of_entry != 0) | (not goes_on))
            if inner.any():
                yield sink(own, of_group, terms, g[inner], c[inner], n[inner])
        if held is not None:
            yield from held.given(sink)

    return run


def _rows_sink(names: list[str]) -> Sink:
    def sink(keys, ids, terms, g, c, n):
        order = np.argsort(g, kind="stable")   # by key, over the lengths of the n-grams
        g, c, n = g[order], c[order], n[order]
        starts = np.union1d(np.flatnonzero(np.diff(g, prepend=-1)), np.arange(0, len(g), LIST_TERMS))
        counted = pa.StructArray.from_arrays([terms.take(pa.array(c)), pa.array(n, pa.int64())], names=["term", "tf"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(g)), pa.int32()), counted)
        at = pa.array(g[starts])
        return pa.record_batch([*(k.take(at) for k in keys), lists], names=[*names, "_counted"])
    return sink


def _totals_sink(keys, ids, terms, g, c, n):
    df = np.bincount(c, minlength=len(terms))
    used = np.flatnonzero(df)
    ctf = np.bincount(c, weights=n, minlength=len(terms)).astype(np.int64)
    return pa.record_batch([terms.take(pa.array(used)), pa.array(df[used], pa.int64()), pa.array(ctf[used])], names=["term", "df", "ctf"])


def _weights_sink(names: list[str], vocabulary, sublinear_tf: bool) -> Sink:
    def sink(keys, ids, terms, g, c, n):
        known, idx, idf = vocabulary.value
        place = pc.index_in(terms, value_set=known).to_numpy(zero_copy_only=False)[c].astype(np.int64)
        w = (1.0 + np.log(n) if sublinear_tf else n.astype(np.float64)) * idf[place]
        norm = np.sqrt(np.bincount(ids[g], weights=w * w))   # of the id's whole row
        at = pa.array(g)
        return pa.record_batch([*(k.take(at) for k in keys), known.take(pa.array(place)), pa.array(idx[place]), pa.array(w / norm[ids[g]])],
                               names=[*names, "term", "idx", "weight"])
    return sink


def _over(texts: DataFrame, keys: list[str], tokens, run, schema: T.StructType) -> DataFrame:
    """``run`` over the partitions of ``texts``, which hold all rows of their keys."""
    return texts.sortWithinPartitions(*keys).select(*keys, tokens.alias("_tokens")).mapInArrow(run, schema)


def _with(texts: DataFrame, keys: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*(T.StructField(k, texts.schema[k].dataType) for k in keys), *(T.StructField(*m) for m in more)])


def row_counts(texts: DataFrame, keys: list[str], tokens, ngram_range: tuple[int, int], among: pa.Array | None = None,
               chars: bool = False) -> DataFrame:
    """(keys..., term, tf): n-gram counts of each key; with ``among`` those of its terms alone."""
    held = None if among is None else texts.sparkSession.sparkContext.broadcast((among,))
    counted = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    schema = _with(texts, keys, ("_counted", T.ArrayType(counted)))
    return _over(texts, keys, tokens, counting(ngram_range, _rows_sink(keys), held, chars), schema).select(*keys, F.inline("_counted"))


def term_totals(texts: DataFrame, keys: list[str], tokens, ngram_range: tuple[int, int], parts: int) -> DataFrame:
    """(term, df, ctf): of each term the keys that hold it and its count in them all.

    The tasks' sums are dealt out once, into ``parts`` partitions: a task's table of terms keeps its size whatever the input."""
    sums = slice_totals(texts, keys, tokens, ngram_range).repartition(parts, "term")
    return sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def char_totals(texts: DataFrame, keys: list[str], tokens, ngram_range: tuple[int, int]) -> DataFrame:
    """``term_totals`` of character n-grams: few are different, so a task's sums are added up before they are dealt out."""
    return slice_totals(texts, keys, tokens, ngram_range, True).groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def slice_totals(texts: DataFrame, keys: list[str], tokens, ngram_range: tuple[int, int], chars: bool = False) -> DataFrame:
    """(term, df, ctf) of every slice of a task."""
    schema = _with(texts, [], ("term", T.StringType()), ("df", T.LongType()), ("ctf", T.LongType()))
    return _over(texts, keys, tokens, counting(ngram_range, _totals_sink, chars=chars), schema)


def row_weights(texts: DataFrame, keys: list[str], names: list[str], tokens, ngram_range: tuple[int, int], vocabulary: pa.Table,
                sublinear_tf: bool, chars: bool = False) -> DataFrame:
    """(names..., term, idx, weight): tf x idf of each key's terms, L2-normalised for each id, by a vocabulary (term, idx, idf)
    that the caller has found small enough for every task."""
    v = vocabulary.combine_chunks()
    terms = pa.concat_arrays(v["term"].chunks) if v.num_rows else pa.array([], pa.string())
    held = texts.sparkSession.sparkContext.broadcast((terms, v["idx"].to_numpy(), v["idf"].to_numpy()))
    schema = _with(texts, keys, ("term", T.StringType()), ("idx", T.LongType()), ("weight", T.DoubleType()))
    return _over(texts, keys, tokens, counting(ngram_range, _weights_sink(keys, held, sublinear_tf), held, chars), schema).select(*names, "term", "idx", "weight")
