"""XOR ciphers of protected datasets: there is no byte-wise XOR among Spark's functions, so these are vectorized UDFs."""

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _xor(data: bytes, key: bytes) -> bytes:
    if not data or not key:
        return data
    return (np.frombuffer(data, np.uint8) ^ np.resize(np.frombuffer(key, np.uint8), len(data))).tobytes()


def xor_with_key(data: Column, key: str) -> Column:
    """Bytes XORed with a repeating key; applied twice it gives the input back."""
    raw = key.encode()

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else _xor(bytes(b), raw))

    return run(data)


def decrypt_cell(cell: Column, password: Column) -> Column:
    """A base64 cell, XORed with the repeated SHA-256 of its password, as text; null if it isn't one."""

    @F.pandas_udf("string")
    def run(x: pd.Series, p: pd.Series) -> pd.Series:
        def one(c, w):
            if c is None or w is None:
                return None
            try:
                return _xor(base64.b64decode(c), hashlib.sha256(w.encode()).digest()).decode()
            except ValueError:
                return None

        return pd.Series([one(c, w) for c, w in zip(x, p, strict=True)], dtype=object)

    return run(cell, password)


def encrypt_cell(text: Column, password: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or w is None else base64.b64encode(_xor(c.encode(), hashlib.sha256(w.encode()).digest())).decode() for c, w in zip(x, p, strict=True)], dtype=object)

    return run(text, password)
