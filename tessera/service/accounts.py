"""Accounts: password envelopes, session tokens, and the rules of a roster of users.

users: (user_id, username, password_hash, role, active, created_at); sessions: (token_hash, user_id).
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.errors import RequestShape, UnknownField

# The form of a stored password is algorithm$hash$iterations$salt$key, both in base64 without padding.
ALGORITHM, HASH, ITERATIONS, SALT_BYTES, KEY_BYTES, MOST_ITERATIONS = "pbkdf2", "sha256", 600_000, 16, 32, 20_000_000
ADMIN, MEMBER = "admin", "member"


def _encoded(data: bytes) -> str:
    return base64.b64encode(data).decode().rstrip("=")


def _decoded(text: str) -> bytes:
    return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)


def hash_password(password: str, iterations: int = ITERATIONS) -> str:
    salt = secrets.token_bytes(SALT_BYTES)
    return "$".join([ALGORITHM, HASH, str(iterations), _encoded(salt), _encoded(hashlib.pbkdf2_hmac(HASH, password.encode(), salt, iterations, KEY_BYTES))])


def verify_password(password: str, envelope: str) -> bool:
    """In constant time; an envelope that cannot be read matches nothing."""
    try:
        algorithm, name, iterations, salt, key = envelope.split("$")
        rounds, salt, key = int(iterations), _decoded(salt), _decoded(key)
    except ValueError:
        return False
    if (algorithm, name) != (ALGORITHM, HASH) or not 1 <= rounds <= MOST_ITERATIONS or not salt or not key:
        return False
    return hmac.compare_digest(hashlib.pbkdf2_hmac(HASH, password.encode(), salt, rounds, len(key)), key)


def new_session(sessions: DataFrame, user_id: str) -> tuple[str, DataFrame]:
    """(token, sessions): only the token's digest is stored."""
    token = secrets.token_urlsafe(32)
    row = sessions.sparkSession.createDataFrame([(digest(token), user_id)], "token_hash string, user_id string")
    return token, sessions.unionByName(row)


def digest(token: str) -> str:
    return hashlib.sha256(token.encode()).hexdigest()


def session_user(sessions: DataFrame, users: DataFrame, token: str) -> DataFrame:
    """The active user of a session, or no row: a deactivated user's session is none."""
    return users.where("active").join(F.broadcast(sessions.where(F.col("token_hash") == digest(token)).select("user_id")), "user_id", "left_semi")  # one digest


def without_session(sessions: DataFrame, token: str) -> DataFrame:
    return sessions.where(F.col("token_hash") != digest(token))


def update_user(users: DataFrame, user_id: str, **changes) -> DataFrame:
    """users with one account changed; what is not named stays.

    A name that another account has, whatever its case, is refused, and so is a change after which no active admin would be left.
    """
    if unknown := set(changes) - {"username", "password_hash", "role", "active"}:
        raise RequestShape(f"no account field {sorted(unknown)[0]}")
    mine = F.col("user_id") == user_id
    found = users.where(mine).first()
    if found is None:
        raise UnknownField(user_id)
    if "username" in changes and not users.where(~mine & (F.lower("username") == changes["username"].lower())).isEmpty():
        raise RequestShape("the username is taken")
    was_admin = found["role"] == ADMIN and found["active"]
    stays_admin = changes.get("role", found["role"]) == ADMIN and changes.get("active", found["active"])
    if was_admin and not stays_admin and users.where(~mine & (F.col("role") == ADMIN) & F.col("active")).isEmpty():
        raise RequestShape("the last active admin cannot be removed")
    return users.withColumns({c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})
