"""Screens of transactions with tokenised accounts and encrypted amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import ope_encrypt, ore_between, ore_compare, ore_encrypt, scaled
from ..functions.prf import hmac256
from ..sources.keys import Key


def encrypted_transactions(rows: DataFrame, account: Column, amount: Column, token: Key | None = None, ope: Key | None = None, ore: tuple[Key, Key] | None = None) -> DataFrame:
    """Adds account_token, amount_ope and amount_ore, each if its key is given: a job makes what it asks for only."""
    units, made = scaled(amount), {}
    if token:
        made["account_token"] = F.base64(hmac256(token, account.cast("string")))
    if ope:
        made["amount_ope"] = ope_encrypt(units, ope)
    if ore:
        made["amount_ore"] = ore_encrypt(units, *ore)
    return rows.withColumns(made)


def at_least(cipher: Column, bound: Column) -> Column:
    """Large transactions: from the threshold on, order-preserving."""
    return cipher >= bound


def between(cipher: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Inclusive range, order-preserving; either bound may be open."""
    out = F.lit(True)
    out = out & (cipher >= low) if low is not None else out
    return out & (cipher <= high) if high is not None else out


def unusual(cipher: Column, bound: Column) -> Column:
    """Amounts above the threshold, order-revealing."""
    return ore_compare(cipher, bound) > 0


def rapid_accounts(rows: DataFrame, most: int, account: str = "account_token") -> DataFrame:
    """Accounts with more than ``most`` transactions."""
    return rows.groupBy(account).agg(F.count("*").alias("n")).filter(F.col("n") > most)


def flagged(rows: DataFrame, accounts: DataFrame, account: str = "account_token") -> DataFrame:
    """Transactions of flagged accounts."""
    return rows.join(accounts, account, "left_semi")


def in_ore_range(rows: DataFrame, low: Column | None, high: Column | None, cipher: str = "amount_ore") -> DataFrame:
    return rows.filter(ore_between(F.col(cipher), low, high))
