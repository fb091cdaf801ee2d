"""Words of a text, in the JVM and as hashes in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_words(text: Column) -> Column:
    """The longest runs of Unicode letters and digits of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a list array, and the offsets of its lists; each distinct word is hashed once."""
    flat = words.flatten().dictionary_encode()
    known = pd.util.hash_array(flat.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    hashes = known[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return hashes, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
