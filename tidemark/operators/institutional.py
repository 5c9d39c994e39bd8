"""Snapshots of institutions kept as JSON payloads: read leniently element by element, written back whole.

A payload is a VARIANT: it needs no schema of its own, and one bad element of a list costs that element alone. What an element
must have (`NEEDS`) decides whether it is kept; its other fields are null, or their default, where they are missing or no such value.

Defined results: a payload that is null or no JSON object gives empty lists and null numbers (`broken` is true); lists that are no
lists are empty; repeated rows each give a row; rows with a null symbol or session are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of the lists' elements with their types, what an element needs, and defaults.
LISTS = {
    "insider_monthly": {
        "month": "int", "year": "int", "shares_bought": "double", "insiders_buy_count": "int", "shares_sold": "double", "insiders_sell_count": "int",
        "trans_buy_count": "int", "trans_sell_count": "int", "trans_buy_amount": "double", "trans_sell_amount": "double",
        "informative_buy_count": "int", "informative_sell_count": "int", "informative_buy_amount": "double", "informative_sell_amount": "double",
    },
    "recent_insider_transactions": {
        "name": "string", "is_officer": "boolean", "is_director": "boolean", "is_ten_percent_owner": "boolean", "officer_title": "string", "action": "int",
        "operation_description": "string", "amount": "double", "number_of_shares": "double", "r_date": "date", "estimated_shares_value": "double", "link": "string",
    },
    "hedge_fund_holdings_by_quarter": {
        "date": "date", "holding_amount": "double", "institution_holding_percentage": "double", "net_shares_change": "double",
        "number_of_shares_bought": "double", "number_of_shares_sold": "double", "is_complete": "boolean",
    },
    "notable_holder_moves": {
        "manager_name": "string", "institution_name": "string", "action": "int", "effective_date": "date", "value": "double", "change_pct": "double",
        "change_amount": "double", "percentage_of_portfolio": "double", "stars": "double", "is_active": "boolean",
    },
}
NEEDS = {"insider_monthly": ("month", "year"), "recent_insider_transactions": ("name",), "hedge_fund_holdings_by_quarter": ("date",), "notable_holder_moves": ()}
NUMBERS = {
    "insider_net_3m_usd": "double", "insider_confidence_stock_score": "double", "insider_confidence_sector_score": "double", "num_of_insiders": "int",
    "hedge_fund_sentiment": "double", "hedge_fund_trend_action": "int", "hedge_fund_trend_value": "double", "market_cap_usd": "double",
}
DEFAULTS = {
    **{k: 0 for k in LISTS["insider_monthly"] if k.endswith("_count")}, "is_officer": False, "is_director": False, "is_ten_percent_owner": False,
    "is_complete": False, "is_active": True, "manager_name": "", "institution_name": "",
}


def _field(x: Column, name: str, kind: str) -> Column:
    value = F.try_variant_get(x, f"$.{name}", kind) if kind != "date" else F.try_to_date(F.try_variant_get(x, f"$.{name}", "string"), "yyyy-MM-dd")
    return F.coalesce(value, F.lit(DEFAULTS[name])) if name in DEFAULTS else value


def _list(payload: Column, name: str) -> Column:
    """The good elements of a list, as structs."""
    elements = F.coalesce(F.try_variant_get(payload, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(elements, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    parsed = F.transform(objects, lambda x: F.struct(*(_field(x, f, kind).alias(f) for f, kind in LISTS[name].items())))
    return F.filter(parsed, lambda s: _has(s, NEEDS[name])) if NEEDS[name] else parsed


def _has(s: Column, needs: tuple[str, ...]) -> Column:
    found = F.lit(True)
    for n in needs:
        found = found & s[n].isNotNull() & (s[n].cast("string") != "")
    return found


def read(rows: DataFrame) -> DataFrame:
    """symbol, session, lists and numbers of rows(symbol, session, payload string)."""
    p = rows.select("symbol", "session", F.try_parse_json("payload").alias("p"))
    lists = {n: _list(F.col("p"), n) for n in LISTS}
    numbers = {n: F.try_variant_get("p", f"$.{n}", kind) for n, kind in NUMBERS.items()}
    broken = ~F.coalesce(F.schema_of_variant("p").startswith("OBJECT"), F.lit(False))
    return p.select("symbol", "session", *(c.alias(n) for n, c in (lists | numbers).items()), broken.alias("broken"))


def write(snapshots: DataFrame) -> DataFrame:
    """rows(symbol, session, payload) that read() turns into the same snapshots."""
    return snapshots.select("symbol", "session", F.to_json(F.struct(*LISTS, *NUMBERS), {"ignoreNullFields": "true"}).alias("payload"))


def latest_and_previous(rows: DataFrame, as_of: Column) -> DataFrame:
    """For each symbol its two newest snapshots up to a day, rank 1 and 2. Payloads are parsed for these rows alone."""
    w = Window.partitionBy("symbol").orderBy(F.desc("session"))
    return rows.where(F.col("session") <= as_of).withColumn("rank", F.row_number().over(w)).where("rank <= 2")


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Snapshots by (symbol, session): the fresh one replaces the stored one. fresh has one row a key."""
    kept = stored.join(fresh.select("symbol", "session"), ["symbol", "session"], "left_anti")
    return kept.select("symbol", "session", "payload").unionByName(fresh.select("symbol", "session", "payload"))
