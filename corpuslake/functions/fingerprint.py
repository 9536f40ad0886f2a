"""FNV-1a hashes and the distance of fingerprints as native expressions; SimHash fingerprints by Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.tokens import tokens
from corpuslake.operators.common import spread

#: Fixed values of FNV-1a with 64 bits: the offset basis 14695981039346656037 in two halves, and the low part of the prime 2**40 + 435.
BASIS_HIGH, BASIS_LOW, PRIME_LOW = 0xCBF29CE4, 0x84222325, 0x1B3
MASK = 0xFFFFFFFF


def fnv1a(word: Column) -> Column:
    """The hash of a word's UTF-8 bytes as a signed number; the two halves never overflow."""
    data = F.hex(word.cast("binary"))
    start = F.struct(F.lit(BASIS_HIGH).cast("long").alias("hi"), F.lit(BASIS_LOW).cast("long").alias("lo"))

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.substring(data, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
        x = acc["lo"].bitwiseXOR(byte)
        low = x * PRIME_LOW
        high = acc["hi"] * PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(F.lit(MASK)).alias("hi"), low.bitwiseAND(F.lit(MASK)).alias("lo"))

    n = F.octet_length(word)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda a: F.shiftleft(a["hi"], 32).bitwiseOR(a["lo"]))


def fnv1a_words(words: list[str]) -> np.ndarray:
    """The hashes of many words as unsigned numbers, byte place by byte place; the rest of a word over 64 bytes on its own."""
    coded = [w.encode() for w in words]
    sizes = np.array([len(c) for c in coded], dtype=np.int64)
    width = int(min(sizes.max(initial=0), 64))
    table = np.frombuffer(b"".join(c[:width].ljust(width, b"\0") for c in coded), dtype=np.uint8).reshape(len(coded), width)
    basis, prime = BASIS_HIGH << 32 | BASIS_LOW, (1 << 40) + PRIME_LOW
    hashes = np.full(len(coded), basis, dtype=np.uint64)
    for place in range(width):
        live = sizes > place
        hashes[live] = (hashes[live] ^ table[live, place]) * np.uint64(prime)  # wraps at 64 bits
    for i in np.flatnonzero(sizes > width):
        h = int(hashes[i])
        for byte in coded[i][width:]:
            h = ((h ^ byte) * prime) & ((1 << 64) - 1)
        hashes[i] = h
    return hashes


#: Rows of which a byte can hold the sum, if each adds 1 at most.
LANE_ROWS = 255


def simhash_of(lists: pa.Array) -> pa.Array:
    """A fingerprint for each list of tokens; a token that a batch holds often is hashed once.

    A row costs what its own tokens do, however many distinct ones its batch holds: a token's 64 bits are 64 bytes, added up eight at a time.
    """
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    words = lists.flatten().dictionary_encode()
    hashes = fnv1a_words(words.dictionary.to_pylist())
    lanes = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    places = words.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64).tolist()
    out = np.zeros(len(ends), dtype=np.uint64)
    begin = 0
    for row, end in enumerate(ends):
        if end > begin:
            ones = np.zeros(64, dtype=np.int64)
            for at in range(begin, end, LANE_ROWS):
                ones += np.add.reduce(lanes[places[at : min(at + LANE_ROWS, end)]], axis=0).view(np.uint8)
            out[row] = np.packbits(2 * ones > end - begin, bitorder="little").view("<u8")[0]
        begin = end
    return pa.array(out.view(np.int64))


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash) of each row: a bit is set where the tokens that have it outweigh those that don't; 0 without tokens.

    A row's fingerprint comes from the row alone, so nothing is shuffled but rows of a table of few row groups, and
    texts stay behind: tokens are split in the JVM and go to Python as Arrow lists.
    """
    mark = F.arrow_udf(simhash_of, "bigint")
    return spread(df.select(key, text)).select(key, mark(tokens(F.col(text))).alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
