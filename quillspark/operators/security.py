"""AES over binary columns: what stands in for a file's password protection, not its format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _key(password: str):
    """256 bits of a password."""
    return F.unhex(F.sha2(F.encode(F.lit(password), "UTF-8"), 256))


def encrypt(files: DataFrame, password: str, column: str = "content") -> DataFrame:
    """``files`` with ``column`` encrypted (AES-256, GCM, a fresh vector a row) and is_encrypted true; nulls stay."""
    return files.withColumn(column, F.aes_encrypt(F.col(column), _key(password))).withColumn("is_encrypted", F.lit(True))


def decrypt(files: DataFrame, password: str, column: str = "content") -> DataFrame:
    """``files`` with ``column`` decrypted; rows that the password does not open have null there and an error."""
    plain = F.try_aes_decrypt(F.col(column), _key(password))
    marked = files.withColumn("error", F.when(F.col(column).isNotNull() & plain.isNull(), "wrong password"))
    return marked.withColumn(column, plain).withColumn("is_encrypted", F.lit(False))
