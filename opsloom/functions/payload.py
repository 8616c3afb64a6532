"""Decoding of record payloads: base64, then gunzip where it is gzip, then UTF-8."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def _gunzip(data: bytes | None) -> bytes | None:
    if data is None:
        return None
    try:
        return gzip.decompress(bytes(data))
    except (OSError, EOFError, zlib.error):
        return None


@F.pandas_udf(BinaryType())
def gunzip(data: pd.Series) -> pd.Series:
    """Unzipped bytes, null where the bytes are no complete gzip stream."""
    return data.map(_gunzip)


@F.pandas_udf(BinaryType())
def gzip_bytes(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else gzip.compress(bytes(b), mtime=0))


def decode_payload(data: Column) -> Column:
    """Text of a base64 payload.

    Only bytes that start with the gzip mark are handed to Python; all others are null
    there and stay in the JVM.
    """
    raw = F.unbase64(data)
    zipped = F.when(F.hex(F.substring(raw, 1, 2)) == "1F8B", raw)
    return F.make_valid_utf8(F.coalesce(gunzip(zipped), raw).cast("string"))
