"""Language identification by interpolated Kneser-Ney character models.

One model per language over ORDER-grams of letters (other characters are one space).  N-grams are packed into
64-bit keys and stored in sorted arrays; lower orders use continuation counts.  A text gets the
language of the lowest cross-entropy per character.

Training counts the n-grams of all training rows: first inside each task, then by language and key.  Every one is in the model.
Up to CELLS of them (times the languages) are a model that each task holds.  Beyond that the counts stay a table: the same recursion runs
as joins for the n-grams that the texts hold, tasks hold the probabilities of the most frequent ones only (CELLS at most), and the others of a text
meet theirs in a join.  Both ways give the same numbers.

Rejection is calibrated on rows that were not counted: one in CALIBRATE of a language's training rows (if it has LEAST or more)
only gives the cross-entropy that a share RATE of them exceeds; a text above its language's level
is marked in the column `rejected`; the prediction itself stays a learned language.

Defined results for odd input: a null text or one without a letter is `und` with score 0;
without any training row every text is `und`; ties go to the first language in order; repeated
rows are predicted alike; a language of a single row is learned from it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .tables import Scratch, is_training_fold, ready
from .textkit import chunks, column, tidy

ORDER = 4
CELLS = 1 << 24
CALIBRATE, LEAST, RATE = 20, 200, 0.005
#: Characters of a text that counts for the levels.
LONG = 40
BROADCAST_LANGS = 10_000
#: Texts times languages of one block of sums.
SUMS = 1 << 22
#: Keys that a task holds before it passes its counts on.
HELD_KEYS = 1 << 21
FOLDS, HELD = 5, 0
DISCOUNT = 0.75
UNKNOWN = "und"
_BITS = np.uint64(16)
_SPACE = 32

_LETTER: list[np.ndarray] = []


def _tables() -> np.ndarray:
    """For each 16-bit code point its lower-case letter, or a space where it is no letter."""
    if not _LETTER:
        low = np.full(1 << 16, _SPACE, np.uint64)
        for c in range(1 << 16):
            ch = chr(c)
            if ch.isalpha():
                lower = ch.lower()
                low[c] = ord(lower) if len(lower) == 1 and ord(lower) < 1 << 16 else c
        _LETTER.append(low)
    return _LETTER[0]


def _wide(codes: np.ndarray) -> np.ndarray:
    """Code points above 16 bits: letters fold into the surrogate range, which no text holds."""
    values, where = np.unique(codes, return_inverse=True)
    folded = np.array([0xD800 + v % 0x800 if chr(v).isalpha() else _SPACE for v in values.tolist()], np.uint64)
    return folded[where]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with single spaces between words and before each text, and each text's begin."""
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    at = chars[offsets]
    raw = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    codes = _tables()[raw & 0xFFFF]
    wide = np.flatnonzero(raw > 0xFFFF)
    if len(wide):
        codes[wide] = _wide(raw[wide])
    n = len(offsets) - 1
    out = np.empty(len(codes) + n, np.uint64)  # a space before each text
    heads = at[:-1] + np.arange(n)
    body = np.ones(len(out), bool)
    body[heads] = False
    out[heads], out[body] = _SPACE, codes
    head = ~body
    space = out == _SPACE
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & space[:-1]) | head[1:]
    begin = np.concatenate([[0], np.cumsum(np.add.reduceat(keep, heads))]) if n else np.zeros(1, np.int64)
    return out[keep], begin


def grams(codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed ORDER-grams that lie in one text, and each text's first one."""
    n = len(codes) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(begin), np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(ORDER):
        key = (key << _BITS) | codes[k : k + n]
    ok = np.ones(len(codes), bool)
    for b in begin[1:]:
        ok[max(0, b - ORDER + 1) : b] = False
    ok = ok[:n]
    first = np.concatenate([[0], np.cumsum(ok)])
    return key[ok], first[np.minimum(begin, n)]


def scored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed ORDER-grams that texts are scored by, each text's first one, and how many (0: no letter)."""
    codes, begin = letters(data, offsets)
    has = np.add.reduceat(codes != _SPACE, begin[:-1]) > 0
    key, first = grams(codes, begin)
    n = np.diff(first)
    # texts shorter than an ORDER-gram are padded with spaces
    short = np.flatnonzero(has & (np.diff(begin) < ORDER))
    padded = np.zeros(len(short), np.uint64)
    for j, i in enumerate(short):
        own = codes[begin[i] : begin[i + 1]]
        padded[j] = grams(np.concatenate([np.full(ORDER - len(own), _SPACE, np.uint64), own]), np.array([0, ORDER]))[0][0]
    key = np.insert(key, first[short], padded)
    n[short] = 1
    return key, np.concatenate([[0], np.cumsum(n)]), np.where(has, n, 0)


def sums(first: np.ndarray, width: int, values: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """values(a, b), the rows of the keys from a to b, summed by text."""
    total = np.zeros((len(first) - 1, width))
    step = max(1 << 12, SUMS // width)
    for a in range(0, first[-1], step):  # a very long text is looked up in parts
        b = min(a + step, first[-1])
        upto = np.zeros((b - a + 1, width))
        np.cumsum(values(a, b), axis=0, out=upto[1:])
        at = np.clip(first - a, 0, b - a)
        some = np.flatnonzero(at[1:] > at[:-1])
        total[some] += upto[at[some + 1]] - upto[at[some]]
    return total


def blocks(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about 1 MB and at most SUMS texts times languages."""
    step = max(1, SUMS // width)
    for a, b in chunks(offsets, 1 << 20):
        for i in range(a, b, step):
            yield i, min(b, i + step)


class KneserNey:
    """Models of all languages over shared sorted key arrays."""

    def __init__(self, langs: list[str], lang: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.langs = langs
        n_langs = len(langs)
        table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for order in range(ORDER, 0, -1):
            uniq, row = np.unique(keys, return_inverse=True)
            c = np.zeros((len(uniq), n_langs))
            np.add.at(c, (row, lang), counts)
            table[order] = (uniq, c)
            # continuation counts: how many different characters precede each shorter gram
            mask = np.uint64((1 << (16 * (order - 1))) - 1) if order > 1 else np.uint64(0)
            seen = np.argwhere(c > 0)
            keys, lang, counts = uniq[seen[:, 0]] & mask, seen[:, 1], np.ones(len(seen))
        size = max(2.0, len(table[1][0]) + 1.0)
        uniq, c = table[1]
        total = np.maximum(c.sum(0), 1)
        rest = DISCOUNT * (c > 0).sum(0) / total
        rest = np.where(rest > 0, rest, 1)
        self.levels = []
        self.floor = np.log(rest / size)
        lower_keys, lower = uniq, np.log(np.maximum(c - DISCOUNT, 0) / total + rest / size)
        self.levels.append((lower_keys, lower, None, None))
        for order in range(2, ORDER + 1):
            uniq, c = table[order]
            context, row = np.unique(uniq >> _BITS, return_inverse=True)
            total, kinds = np.zeros((len(context), n_langs)), np.zeros((len(context), n_langs))
            np.add.at(total, row, c)
            np.add.at(kinds, row, c > 0)
            weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            mask = np.uint64((1 << (16 * (order - 1))) - 1)
            back = np.exp(self.lookup(uniq & mask, order - 1))
            p = np.maximum(c - DISCOUNT, 0) / np.maximum(total[row], 1) + weight[row] * back
            self.levels.append((uniq, np.log(p), context, np.log(weight)))
        self.levels = [tuple(None if a is None else (a.astype(np.float32) if a.dtype == np.float64 else a) for a in lv) for lv in self.levels]
        self.ceiling = np.full(n_langs, np.inf)

    def lookup(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probabilities, a row per key and a column per language."""
        uniq, logp, context, weight = self.levels[order - 1]
        at = np.minimum(np.searchsorted(uniq, key), len(uniq) - 1)
        out = logp[at].astype(np.float64)
        missing = np.flatnonzero(uniq[at] != key)
        if len(missing):
            if order == 1:
                out[missing] = self.floor
            else:
                lost = key[missing]
                found = self.lookup(lost & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)
                ctx = lost >> _BITS
                c = np.minimum(np.searchsorted(context, ctx), len(context) - 1)
                found += np.where((context[c] == ctx)[:, None], weight[c], 0)
                out[missing] = found
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character in every language for each text, and characters scored (0: no letter)."""
        key, first, n = scored(data, offsets)
        total = sums(first, len(self.langs), lambda a, b: self.lookup(key[a:b]))
        return -total / np.maximum(n, 1)[:, None], n

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        data, offsets = column(texts)
        names, scores, rejected = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for a, b in blocks(offsets, len(self.langs)):
            ce, n = self.entropies(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            best = ce.argmin(1)
            low = ce[np.arange(len(best)), best]
            odds = np.exp(-(ce - low[:, None]) * np.minimum(np.maximum(n, 1), 60)[:, None]).sum(1)
            scores[a:b] = np.where(n > 0, 1 / odds, 0)
            rejected[a:b] = (n > 0) & (low > self.ceiling[best])
            names += [self.langs[i] if k else UNKNOWN for i, k in zip(best, n, strict=True)]
        return names, scores, rejected


def training_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """text, lang and calibrate (whether the row is kept for the levels) of all training rows."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(is_training_fold("doc_id", FOLDS, HELD), F.lit(True))).select("doc_id", "text", "lang")
    large = scratch.cut(rows.groupBy("lang").count().where(F.col("count") >= LEAST).select(F.col("lang").alias("large")), "languages")
    if large.count() <= BROADCAST_LANGS:  # a checked size; else the texts meet the languages in a shuffle
        large = F.broadcast(large)
    joined = rows.join(large, F.col("lang") == F.col("large"), "left")
    apart = F.col("large").isNotNull() & (F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATE)) == 0)
    return joined.select("text", "lang", apart.alias("calibrate"))


def _count(batches: Iterator[pa.RecordBatch], keys: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """lang, key and count of the n-grams of a task's texts; keys(data, offsets) gives them and each text's first one."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def fold() -> int:
        for v, parts_ in held.items():
            if len(parts_) > 1:
                keys, where = np.unique(np.concatenate([k for k, _ in parts_]), return_inverse=True)
                held[v] = [(keys, np.bincount(where, np.concatenate([c for _, c in parts_]), len(keys)).astype(np.int64))]
        return sum(len(k) for x in held.values() for k, _ in x)

    def out() -> Iterator[pa.RecordBatch]:
        fold()
        for v, [(k, c)] in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)], names=["lang", "k", "n"])
        held.clear()

    for batch in batches:
        data, offsets = column(batch.column(0))
        names = np.array(batch.column(1).to_pylist(), object)
        for a, b in chunks(offsets, 1 << 21):
            key, first = keys(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            langs, of = np.unique(names[a:b].astype(str), return_inverse=True)
            of = np.repeat(of, np.diff(first))
            for i, v in enumerate(langs.tolist()):
                k, c = np.unique(key[of == i], return_counts=True)
                held.setdefault(v, []).append((k, c.astype(np.int64)))
                size += len(k)
            if size > HELD_KEYS:
                size = fold()
                if size > HELD_KEYS // 2:
                    yield from out()
                    size = 0
    yield from out()


def held_model(rows: DataFrame, counts: DataFrame) -> KneserNey:
    """The model of counts that fit a task, with the levels of rejection."""
    got = counts.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    where = {v: i for i, v in enumerate(langs)}
    model = KneserNey(langs, np.array([where[v] for v in got.column("lang").to_pylist()]), got.column("k").to_numpy().view(np.uint64), got.column("n").to_numpy().astype(np.float64))

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(0))
            own = np.array([where.get(v, -1) for v in batch.column(1).to_pylist()])
            for a, b in blocks(offsets, len(langs)):
                ce, n = model.entropies(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                long = (n >= LONG) & (own[a:b] >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(own[a:b][long]), pa.array(ce[np.arange(b - a), own[a:b]][long])], names=["l", "ce"])

    stats = rows.where("calibrate").select("text", "lang").mapInArrow(tidy(levels), "l long, ce double").groupBy("l").agg(top("ce")).toArrow().to_pydict()
    for i, level in zip(stats["l"], stats["top"], strict=True):
        model.ceiling[i] = level
    return model


def top(column: str) -> Column:
    return F.percentile_approx(column, 1 - RATE, 10_000).alias("top")


def probabilities(counts: DataFrame, asked: DataFrame, languages: DataFrame, scratch: Scratch) -> DataFrame:
    """asked (k, n) with logp in every language l: the recursion of KneserNey, from counts (l, k, c)."""
    cut_to = lambda order: F.col("k").bitwiseAND(F.lit((1 << 16 * order) - 1))
    context = F.shiftrightunsigned("k", 16)
    seen = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # continuation counts
        seen[order] = scratch.cut(seen[order + 1].groupBy("l", cut_to(order).alias("k")).agg(F.count("*").alias("c")), f"grams-{order}")
    size = max(2.0, seen[1].select("k").distinct().count() + 1.0)
    lower = languages.select("l", F.lit(0).cast("long").alias("suffix"), F.lit(1 / size).alias("back"))
    for order in range(1, ORDER + 1):
        keys = asked if order == ORDER else asked.select(cut_to(order).alias("k")).distinct()
        after = seen[order].groupBy("l", context.alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        each = keys.withColumns({"suffix": cut_to(order - 1), "context": context}).join(lower, "suffix")
        each = each.join(seen[order], ["l", "k"], "left").join(after, ["l", "context"], "left")
        own = F.greatest(F.coalesce("c", F.lit(0)) - DISCOUNT, F.lit(0.0)) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("back")).otherwise(own + DISCOUNT * F.col("kinds") / F.col("total") * F.col("back"))
        lower = each.select(*keys.columns, "l", p.alias("back")).withColumnRenamed("k", "suffix")
    return lower.select(F.col("suffix").alias("k"), "n", "l", F.log("back").cast("float").alias("logp"))


def entropies_by_joins(rows: DataFrame, logp: DataFrame, least: int, n_langs: int, scratch: Scratch) -> DataFrame:
    """rows (text last) with n and ce, the cross-entropy per character in every language; keys of least occurrences or more are held by the tasks."""
    held = logp.where(F.col("n") >= least).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("l", "logp")))["logp"].alias("logp")).toArrow()
    hot = held.column("k").to_numpy().view(np.uint64)
    values = held.column("logp").combine_chunks().flatten().to_numpy().reshape(-1, n_langs) if len(hot) else np.zeros((0, n_langs), np.float32)
    order = np.argsort(hot)  # as unsigned
    hot, values = hot[order], values[order]
    # a last row of zeros for the keys that the tasks do not hold
    values = np.concatenate([values, np.zeros((1, n_langs), np.float32)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(batch.num_columns - 1))
            for a, b in blocks(offsets, n_langs):
                key, first, n = scored(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = np.searchsorted(hot, key)
                here = at < len(hot)
                here[here] = hot[at[here]] == key[here]
                at = np.where(here, at, len(hot))
                total = sums(first, n_langs, lambda i, j, at=at: values[at[i:j]])
                of, key = np.repeat(np.arange(b - a), np.diff(first))[~here], key[~here]
                order = np.lexsort((key, of))
                of, key = of[order], key[order]
                new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])])[: len(of)])
                times = np.diff(np.append(new, len(of)))
                begin = np.searchsorted(of[new], np.arange(b - a + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(begin, pa.array(v)) for v in (key[new].view(np.int64), times.astype(np.int64))]
                held = pa.ListArray.from_arrays((np.arange(b - a + 1) * n_langs).astype(np.int32), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-1]], pa.array(n.astype(np.int64)), held, *lists], names=names)

    carried = rows.select(F.monotonically_increasing_id().alias("row"), *rows.columns)
    names = [*carried.columns[:-1], "n", "held", "keys", "times"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried.schema.fields[:-1])
    scanned = scratch.cut(carried.mapInArrow(tidy(scan), f"{fields}, n long, held array<double>, keys array<long>, times array<long>"), "scanned")
    rest = scanned.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("k"), F.col("x.times").alias("times"))
    rest = rest.join(logp.where(F.col("n") < least).select("k", "l", "logp"), "k").groupBy("row", "l").agg(F.sum(F.col("logp") * F.col("times")).alias("s"))
    rest = rest.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("l", "s")))["s"].alias("rest"))  # one text's languages
    total = F.when(F.col("rest").isNull(), F.col("held")).otherwise(F.zip_with("held", "rest", lambda a, b: a + b))
    per = F.greatest("n", F.lit(1))
    return scanned.join(rest, "row", "left").select(*rows.columns[:-1], "n", F.transform(total, lambda x: -x / per).alias("ce"))


def identify_by_joins(docs: DataFrame, rows: DataFrame, counts: DataFrame, cells: int, scratch: Scratch) -> DataFrame:
    """identify for counts that no task can hold."""
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    languages = docs.sparkSession.createDataFrame(list(enumerate(langs)), "l int, lang string")
    asked = docs.select("text", F.lit("").alias("lang")).mapInArrow(tidy(lambda batches: _count(batches, lambda *texts: scored(*texts)[:2])), "lang string, k long, n long")
    asked = asked.groupBy("k").agg(F.sum("n").alias("n"))
    asked = scratch.cut(asked, "asked")
    logp = scratch.cut(probabilities(counts.join(languages, "lang").select("l", "k", F.col("n").alias("c")), asked, languages, scratch), "probabilities")
    sizes = asked.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("level")).agg(F.count("*").alias("keys"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()  # some hundred rows
    least, total = 1 << 62, 0
    for row in sizes:  # from frequent to rare, what the tasks can hold
        total += row["keys"]
        if total * len(langs) > cells:
            break
        least = row.least
    own = entropies_by_joins(rows.where("calibrate").select("lang", "text"), logp, least, len(langs), scratch).join(languages, "lang")
    tops = own.where(F.col("n") >= LONG).select("l", F.col("ce")[F.col("l")].alias("ce")).groupBy("l").agg(top("ce"))
    tops = scratch.cut(languages.join(tops, "l", "left"), "levels")
    texts = entropies_by_joins(docs.select("doc_id", "held_out", "text"), logp, least, len(langs), scratch)
    low, n = F.array_min("ce"), F.col("n")
    odds = F.aggregate("ce", F.lit(0.0), lambda s, c: s + F.exp((F.col("low") - c) * F.least(n, F.lit(60))))
    best = texts.withColumns({"low": low, "l": (F.array_position("ce", low) - 1).cast("int")}).withColumn("odds", odds)
    out = best.join(tops, "l", "left").select(
        "doc_id", "held_out", F.when(n > 0, F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(n > 0, 1 / F.col("odds")).otherwise(0.0).alias("score"),
        ((n > 0) & F.coalesce(F.col("low") > F.col("top"), F.lit(False))).alias("rejected"),
    )
    out = cut(out, "languages-found")
    scratch.close()
    return out


def identify(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document; cells: keys times languages that a task holds."""
    docs, scratch = ready(docs), Scratch(docs.sparkSession)
    rows = training_rows(docs, scratch)
    counts = rows.where("not calibrate").select("text", "lang").mapInArrow(tidy(lambda batches: _count(batches, lambda *texts: grams(*letters(*texts)))), "lang string, k long, n long")
    counts = scratch.cut(counts.groupBy("lang", "k").agg(F.sum("n").alias("n")), "grams")
    size = counts.agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs")).first()
    held = F.coalesce(~is_training_fold("doc_id", FOLDS, HELD), F.lit(False)).alias("held_out")
    docs = docs.select("doc_id", held, "text")
    if size.n * size.langs > cells:
        return identify_by_joins(docs, rows, counts, cells, scratch)
    model = held_model(rows, counts) if size.n else None
    scratch.close()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                n = len(batch)
                names, scores, rejected = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
            else:
                names, scores, rejected = model.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.mapInArrow(tidy(scan), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
