"""Document fingerprints that add up: a homomorphic hash of the multiset of a text's paragraphs.

Each paragraph (what stands between line feeds) is hashed to a wide vector, and the fingerprint of a text is the sum of
the vectors of its paragraphs, lane by lane modulo 2^32. So the order of paragraphs does not matter, texts can be
fingerprinted part by part, and a paragraph is inserted or deleted by adding or subtracting its vector.

A vector has two parts. ``EQUAL`` lanes are read from salted SHA-256 digests of the whole paragraph: two texts agree there
only if they hold the same paragraphs equally often. ``ALIKE`` lanes are a signed sketch of the paragraph's runs of
``RUN`` words (a shorter paragraph is one run): every run adds +1 or -1 to one lane. Sums of squares and of products of
these lanes estimate those of the counts of runs, with a standard error of about 1 / sqrt(ALIKE) of the product of both
lengths; ``likeness`` is product / (square + square - product), cut to 0..1, and exactly 1 for equal fingerprints.

Texts go through the shuffle once, in ``following``: they are dealt into ranges of ids, of about ``RANGE_BYTES`` of text
each, and sorted there; the first row of each range is sent to the range before it too. A range is read as a stream, so
neither its size nor one id of very many rows is bounded by memory; rows of one id are spread over ranges by their text.

Edge cases: null texts are empty, and an empty text is one empty paragraph; null ids come last, rows of one id are ordered
by the md5 of their text; a single row is its own next one; an empty table gives an empty table. Only the two named columns
are read, so no other column can clash. A run of more than 2^31 equal steps in a lane would wrap there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 3
SALTS = 4
EQUAL, ALIKE = 8 * SALTS, 128
LANES = EQUAL + ALIKE
#: A run's hash has ``BITS`` bits: the top ones name a lane, the next one the sign.
BITS, LANE_BITS = 60, 7
FACTORS = (1, 3, 9)
RANGE_BYTES = 8 << 20
MOST_RANGES = 1 << 16
PIECE_CHARS = 2 << 20
KEPT_WORDS = 1 << 18

_U = np.uint64
_word_hashes: dict[str, int] = {}


def _hash_of(word: str) -> int:
    known = _word_hashes.get(word)
    if known is None:
        if len(_word_hashes) >= KEPT_WORDS:
            _word_hashes.clear()
        known = _word_hashes[word] = int(hashlib.md5(word.encode()).hexdigest()[:BITS // 4], 16)
    return known


def _equal_lanes(paragraphs: list[str], owner: np.ndarray, n: int) -> np.ndarray:
    sha = hashlib.sha256
    digests = bytearray()
    for p in paragraphs:
        name = sha(p.encode()).hexdigest().encode()
        for salt in range(SALTS):
            digests += sha(b"%d:%b" % (salt, name)).digest()
    rows = np.frombuffer(bytes(digests), ">u4").reshape(-1, EQUAL).astype(_U)
    out = np.zeros((n, EQUAL), _U)
    if len(owner):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def _alike_lanes(paragraphs: list[str], owner: np.ndarray, n: int) -> np.ndarray:
    split = pc.split_pattern_regex(pa.array(paragraphs, pa.large_string()), pattern=r"[\x20\x09-\x0D]+")
    place = np.repeat(np.arange(len(paragraphs)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    word = split.flatten()
    full = pc.greater(pc.binary_length(word), 0).to_numpy(zero_copy_only=False)
    place, word = place[full], word.filter(pa.array(full))
    if not len(place):
        return np.zeros((n, ALIKE), np.int64)
    coded = word.dictionary_encode()
    value = np.array([_hash_of(w) for w in coded.dictionary.to_pylist()], _U)[coded.indices.to_numpy()]
    size = np.bincount(place, minlength=len(paragraphs))
    behind = np.arange(len(place)) - (np.cumsum(size) - size)[place]
    starts = np.flatnonzero((behind + RUN <= size[place]) | ((behind == 0) & (size[place] < RUN)))
    run = np.zeros(len(starts), _U)
    for j, factor in enumerate(FACTORS):
        inside = behind[starts] + j < size[place[starts]]
        run[inside] += value[starts[inside] + j] * _U(factor)
    run &= _U((1 << BITS) - 1)
    lane = (run >> _U(BITS - LANE_BITS)).astype(np.int64)
    sign = ((run >> _U(BITS - LANE_BITS - 1)) & _U(1)).astype(np.int64) * 2 - 1
    sums = np.bincount(owner[place[starts]] * ALIKE + lane, weights=sign, minlength=n * ALIKE)
    return sums.astype(np.int64).reshape(n, ALIKE)


def vectors(texts: list[str | None]) -> np.ndarray:
    """The sums of the paragraph vectors of each text, modulo 2^32; ``None`` is no paragraph at all."""
    paragraphs: list[str] = []
    sizes = []
    for text in texts:
        parts = [] if text is None else text.split("\n")
        paragraphs += parts
        sizes.append(len(parts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    lanes = np.hstack([_equal_lanes(paragraphs, owner, len(texts)), _alike_lanes(paragraphs, owner, len(texts)).view(_U)])
    return lanes & _U(0xFFFFFFFF)


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of texts that hold the paragraphs of both."""
    return (a + b) & _U(0xFFFFFFFF)


def removed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of ``a`` after the paragraphs of ``b`` were deleted from it."""
    return (a - b) & _U(0xFFFFFFFF)


def shown(lanes: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal digits, eight for each lane."""
    return [row.tobytes().hex() for row in lanes.astype(">u4")]


def read(fingerprint: str) -> np.ndarray:
    """The lanes of a fingerprint that ``shown`` wrote."""
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(_U)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How alike the texts behind the rows of ``a`` and ``b`` are, from 0 to 1."""
    x, y = (v[:, EQUAL:].astype(np.uint32).view(np.int32).astype(np.float64) for v in (a, b))
    product = (x * y).sum(axis=1)
    whole = (x * x).sum(axis=1) + (y * y).sum(axis=1) - product
    near = np.divide(product, whole, out=np.zeros(len(x)), where=whole > 0)
    return np.where((a == b).all(axis=1), 1.0, np.clip(near, 0.0, 1.0))


def _ranges(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Ids that cut the rows into ranges, largest first (an id may be there repeatedly), and the ranges of null ids."""
    rows, size, missing = docs.agg(
        F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(F.col("doc_id").isNull())).first()
    parts = int(min(MOST_RANGES, max(1, -(-size // RANGE_BYTES))))
    known = max(1, round(parts * (rows - missing) / max(rows, 1)))
    cuts = []
    if known > 1:
        shares = [i / known for i in range(1, known)]
        cuts = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * known))).first()[0] or []
    return np.array(cuts[::-1], np.int64), max(1, parts - known)


def following(docs: DataFrame) -> DataFrame:
    """``place, guest, doc_id, text``: ranges in descending order of ids, as sorted streams of the tasks.

    Rows with ``guest`` come last in their range and only serve as the next row of the last proper one.
    """
    spark = docs.sparkSession
    cuts, for_null = _ranges(docs)
    n = len(cuts) + 1 + for_null

    @F.pandas_udf("int")
    def place(doc_id: pd.Series, missing: pd.Series, tie: pd.Series) -> pd.Series:
        # ranges above an id's first, then its share of those that it fills alone
        above = np.searchsorted(~cuts, ~doc_id.to_numpy(np.int64), "left")
        upto = np.searchsorted(~cuts, ~doc_id.to_numpy(np.int64), "right")
        share = np.array([int(t[:8], 16) for t in tie], np.float64) / 2.0 ** 32
        own = above + (share * (upto - above + 1)).astype(np.int64)
        of_null = len(cuts) + 1 + (share * for_null).astype(np.int64)
        return pd.Series(np.where(missing.to_numpy(bool), of_null, own))

    missing = F.col("doc_id").isNull()
    rows = (
        docs.withColumn("tie", F.md5("text"))
        .withColumn("place", place(F.coalesce("doc_id", F.lit(0)).cast("long"), missing, F.col("tie")))
        .withColumn("key", F.struct(missing.alias("last"), F.bitwise_not(F.coalesce("doc_id", F.lit(0)).cast("long")).alias("down"),
                                    "tie"))
    )
    # one row for each range, of which there are at most MOST_RANGES and one
    heads = rows.groupBy("place").agg(F.min("key").alias("key")).orderBy("place").collect()
    before = {heads[i].place: heads[i - 1].place for i in range(len(heads))}
    sent = spark.createDataFrame(
        [(h.place, h.key.last, h.key.down, h.key.tie, before[h.place]) for h in heads],
        "h_place int, h_last boolean, h_down long, h_tie string, also int")
    first = (F.col("place") == F.col("h_place")) & (F.col("key") == F.struct(
        F.col("h_last").alias("last"), F.col("h_down").alias("down"), F.col("h_tie").alias("tie")))
    dealt = F.array(F.struct(F.col("place").alias("place"), F.lit(False).alias("guest")),
                    F.struct(F.col("also").alias("place"), F.lit(True).alias("guest")))
    return (
        rows.join(F.broadcast(sent), first, "left")
        .select("doc_id", "text", "key", F.explode(F.filter(dealt, lambda d: d["place"].isNotNull())).alias("dealt"))
        .select("dealt.place", "dealt.guest", "key", "doc_id", "text")
        .repartition(n, "place").sortWithinPartitions("place", "guest", "key")
        .select("place", "guest", "doc_id", "text")
    )


def _edited(text: str, after: str) -> tuple[str, str | None, str, str]:
    """The edited text; the paragraphs both texts share before the cut, and what follows in the old and the new text."""
    half = len(text) // 2
    cut = len(text) - half
    edited = text[:cut] + after[:half]
    end = text.rfind("\n", 0, cut)
    return edited, text[:end] if end >= 0 else None, text[end + 1:], edited[end + 1:]


_OUT = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(ids: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """All rows but the last one, each with the next; the edited fingerprint is the old one, updated."""
    n = len(texts) - 1
    cut = [_edited(texts[i], texts[i + 1]) for i in range(n)]
    sums = vectors([c[1] for c in cut] + [c[2] for c in cut] + [c[3] for c in cut] + texts[n:])
    old = added(sums[:n], sums[n:2 * n])
    new = added(removed(old, sums[n:2 * n]), sums[2 * n:3 * n])
    after = np.vstack([old[1:], sums[3 * n:]])
    columns = [
        pa.array(ids[:n], kind), pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(c[0].encode()).hexdigest() for c in cut]), pa.array(shown(old)), pa.array(shown(new)),
        pa.array(likeness(old, new)), pa.array(likeness(old, after))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", *_OUT.names])


def _range_rows(batches):
    place, ids, texts, closed, size = None, [], [], False, 0
    for batch in batches:
        kind = batch.column(2).type
        for at, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if at != place:
                if len(texts) > 1:
                    yield _compared(ids, texts, kind)
                place, ids, texts, closed, size = at, [], [], False, 0
            if closed:
                continue
            ids.append(doc_id)
            texts.append(text)
            closed, size = guest, size + len(text)
            if size >= PIECE_CHARS and len(texts) > 1:
                yield _compared(ids, texts, kind)
                ids, texts, size = ids[-1:], texts[-1:], len(text)
    if len(texts) > 1:
        yield _compared(ids, texts, kind)


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, and that of the text whose second half is replaced from the start of the next one.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``; the next row is the one
    with the next smaller id, after the smallest the largest. Ids are whole numbers.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return following(source).mapInArrow(
        _range_rows, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                     "near_edited double, near_next double")


def _text_rows(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= PIECE_CHARS):
                size += len(texts[end])
                end += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, end - start), pa.array(shown(vectors(texts[start:end])))], names=["doc_id", "fingerprint"])
            start = end


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row, without a shuffle."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_text_rows, f"doc_id {kind}, fingerprint string")


def updated(rows: DataFrame, fingerprint: str, inserted: str, deleted: str) -> DataFrame:
    """``rows`` with ``fingerprint`` brought up to date from the paragraphs in two text columns; null is none of them."""
    @F.pandas_udf("string")
    def change(old: pd.Series, plus: pd.Series, minus: pd.Series) -> pd.Series:
        lanes = np.array([read(f) for f in old]).reshape(len(old), LANES)
        none = lambda texts: [t if isinstance(t, str) else None for t in texts]
        return pd.Series(shown(removed(added(lanes, vectors(none(plus))), vectors(none(minus)))))

    return rows.withColumn(fingerprint, change(fingerprint, inserted, deleted))
