"""At-rest protection of durable vault originals, as Spark SQL expressions.

* sub-keys: SHA-256 of a domain label followed by the passphrase;
* lookup: lower-hex SHA-256 of mac-key || tag || 0x1f || original — rows
  dedupe without revealing the original;
* seal: AES-256-GCM, stored as 12-byte nonce || ciphertext || 16-byte tag
  (the layout ``aes_encrypt(..., 'GCM')`` writes), open with
  ``try_aes_decrypt`` (NULL for a short blob or a wrong key).

Keys enter the plan as literals: set ``spark.sql.redaction.string.regex`` so
they are masked in plans and logs, and decrypt only inside restore jobs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domain labels of the two sub-keys (stored vaults depend on them).
ENC_DOMAIN = "cloakroom seal 1:"
MAC_DOMAIN = "cloakroom lookup 1:"


def subkey(domain: str, passphrase: str) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(domain), F.lit(passphrase)).cast("binary"), 256))


def lookup_key(tag: Column, original: Column, passphrase: str | None) -> Column:
    if passphrase is None:
        return original
    msg = F.concat(
        subkey(MAC_DOMAIN, passphrase),
        F.encode(tag, "UTF-8"),
        F.unhex(F.lit("1f")),
        F.encode(original, "UTF-8"),
    )
    return F.sha2(msg, 256)


def seal(original: Column, passphrase: str | None) -> Column:
    if passphrase is None:
        return F.encode(original, "UTF-8")
    return F.aes_encrypt(original.cast("binary"), subkey(ENC_DOMAIN, passphrase), F.lit("GCM"))


def unseal(sealed: Column, passphrase: str | None) -> Column:
    if passphrase is None:
        return F.decode(sealed, "UTF-8")
    return F.try_aes_decrypt(sealed, subkey(ENC_DOMAIN, passphrase), F.lit("GCM")).cast("string")
