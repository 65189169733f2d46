"""Canonical JSON, content hashes and column encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "enc:v1"
HEX64 = "^[0-9a-f]{64}$"


def _sorted(col: Column, dtype: T.DataType) -> Column:
    """The same value with the fields of every struct in name order."""
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        return F.when(col.isNotNull(), F.struct(*[
            _sorted(col[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _sorted(x, dtype.elementType))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return col


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """JSON of the named columns: keys sorted at every depth, arrays in order, nulls kept."""
    types = {f.name: f.dataType for f in df.schema.fields}
    record = F.struct(*[_sorted(F.col(c), types[c]).alias(c) for c in sorted(columns)])
    return F.to_json(record, {"ignoreNullFields": "false"})


def content_hash(df: DataFrame, columns: list[str]) -> Column:
    return F.sha2(canonical_json(df, columns), 256)


def is_hex_digest(col: Column) -> Column:
    return F.coalesce(col.rlike(HEX64), F.lit(False))


def clean_root(root: Column) -> Column:
    return F.lower(F.regexp_replace(root, "(?i)^0x", ""))


def _url64(data: Column) -> Column:
    plain = F.regexp_replace(F.base64(data), r"[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


def _from_url64(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    pad = F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)))
    return F.unbase64(F.concat(plain, pad))


def encrypt_columns(df: DataFrame, names: list[str], key: Column) -> DataFrame:
    """Encrypt columns in place with AES-256-GCM as prefix:iv:tag:ciphertext; nulls stay."""
    return df.select(*[
        F.transform(
            F.array(F.hex(F.aes_encrypt(F.encode(F.col(c).cast("string"), "UTF-8"), key, F.lit("GCM")))),
            _packed,
        )[0].alias(c) if c in names else F.col(c)
        for c in df.columns
    ])


def _packed(sealed_hex: Column) -> Column:
    # bound through a lambda, so the random vector is drawn once and shared by the parts
    return F.when(sealed_hex.isNotNull(), F.concat_ws(
        ":", F.lit(PREFIX),
        _url64(F.unhex(F.substring(sealed_hex, 1, 24))),
        _url64(F.unhex(F.substring(sealed_hex, -32, 32))),
        _url64(F.unhex(F.substring(sealed_hex, F.lit(25), F.length(sealed_hex) - 56))),
    ))


def decrypt_col(value: Column, key: Column) -> Column:
    """Plain text of an encrypted value; anything without the prefix passes through."""
    parts = F.split(value, ":")
    sealed = F.concat(
        _from_url64(F.get(parts, F.lit(2))), _from_url64(F.get(parts, F.lit(4))),
        _from_url64(F.get(parts, F.lit(3))))
    return F.when(
        value.startswith(PREFIX + ":"), F.decode(F.aes_decrypt(sealed, key, F.lit("GCM")), "UTF-8")
    ).otherwise(value)
