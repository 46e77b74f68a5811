"""Rules that change a small state in log order: cart proposals (A11), quantity changes
and a buyer's preferences (T12).  Each is a ``start`` and a ``step`` for ``operators.fold``;
everything that one row can tell (a product's data, whether a text may be stored) is a
column before the walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import money_to_cents
from ..functions.text import contains_pii, detect_injection
from .catalog import INT_MAX, MAX_CART_LINES
from .domain import valid_preference
from .fold import fold_rows

MAX_PROPOSAL = 20
KEPT_RESULTS = 50
MAX_PREFERENCES = 20
_LINES = "array<struct<product_id:bigint,quantity:bigint,unit_amount:bigint>>"


# ------------------------------------------------------------------------- carts
def _cart(row: dict) -> dict:
    lines = {x["product_id"]: (x["quantity"], x["unit_amount"]) for x in (row["lines"] if row["lines"] is not None else ())}
    return {"lines": lines, "locked": bool(row["locked"]), "results": {}}


def _final_lines(cart: dict) -> list[dict]:
    return [{"line": i, "product_id": p, "quantity": q, "unit_amount": a} for i, (p, (q, a)) in enumerate(cart["lines"].items(), 1)]


def _propose(cart: dict, row: dict) -> dict:
    done = cart["results"].get(row["action_id"])
    if done is None:
        done = _proposal(cart, row)
        cart["results"][row["action_id"]] = done
        if len(cart["results"]) > KEPT_RESULTS:  # the oldest result is forgotten
            del cart["results"][next(iter(cart["results"]))]
    return done


def _proposal(cart: dict, row: dict) -> dict:
    def fail(reason: str) -> dict:
        return {"applied": False, "quantity_in_cart": None, "reason": reason}

    if cart["locked"]:
        return fail("checkout_locked")
    if not row["found"]:
        return fail("not_found")
    quantity, stock, amount = row["quantity"], row["stock"], row["unit_amount"]
    if not row["complete"] or quantity is None or not 1 <= quantity <= MAX_PROPOSAL:
        return fail("invalid")
    before = cart["lines"].get(row["product_id"])
    total = quantity + (before[0] if before else 0)
    if total > INT_MAX:
        return fail("invalid")
    if total > stock:
        return fail("stock")
    if not before and len(cart["lines"]) >= MAX_CART_LINES:
        return fail("cart_full")
    cart["lines"][row["product_id"]] = (total, amount)  # a known product keeps its line
    return {"applied": True, "quantity_in_cart": total, "reason": None}


def _set_quantity(cart: dict, row: dict) -> dict:
    quantity, product = row["quantity"], row["product_id"]
    before = cart["lines"].get(product)
    held = before[0] if before else 0
    if cart["locked"]:
        return {"applied": False, "reason": "checkout_locked"}
    if not row["found"]:
        return {"applied": False, "reason": "not_found"}
    if quantity is None or quantity < 0 or not row["complete"]:
        return {"applied": False, "reason": "invalid"}
    if quantity > row["stock"] and quantity >= held:
        return {"applied": False, "reason": "stock"}
    if quantity == 0:
        cart["lines"].pop(product, None)
    elif not before and len(cart["lines"]) >= MAX_CART_LINES:
        return {"applied": False, "reason": "cart_full"}
    else:
        cart["lines"][product] = (quantity, row["unit_amount"])
    return {"applied": True, "reason": None}


def _with_facts(carts: DataFrame, locked: DataFrame, changes: DataFrame, products: DataFrame, more: list[str]) -> DataFrame:
    """Changes with their product's data and their cart's first state (at most 20 lines)."""
    cents = money_to_cents("price")
    facts = products.select("product_id", F.lit(True).alias("found"), F.col("stock").cast("bigint").alias("stock"), cents.cast("bigint").alias("unit_amount"),
                            F.coalesce(F.col("title").isNotNull() & (F.col("stock") >= 0) & (F.col("price") >= 0), F.lit(False)).alias("complete"))
    lines = carts.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("line", "product_id", "quantity", "unit_amount"))).alias("l"))
    lines = lines.select("owner", F.transform("l", lambda x: F.struct(
        x["product_id"].cast("bigint").alias("product_id"), x["quantity"].cast("bigint").alias("quantity"),
        x["unit_amount"].cast("bigint").alias("unit_amount"))).alias("lines"))
    return (changes.select("owner", "occurred_at", "event_id", *more, F.col("product_id").cast("bigint").alias("product_id"),
                           F.col("quantity").cast("bigint").alias("quantity"))
            .join(facts, "product_id", "left").join(lines, "owner", "left")
            .join(locked.select("owner").distinct().withColumn("locked", F.lit(True)), "owner", "left")
            .withColumn("found", F.coalesce("found", F.lit(False))).withColumn("locked", F.coalesce("locked", F.lit(False))))


def apply_cart_proposals(carts: DataFrame, locked: DataFrame, proposals: DataFrame, products: DataFrame, lines: bool = False) -> DataFrame:
    """``owner, occurred_at, event_id, action_id, product_id, applied, quantity_in_cart, reason``
    of every proposal, in order of (``occurred_at, event_id``).

    First of: the cart has an open checkout (``checkout_locked``); no such product
    (``not_found``); a quantity outside 1 to 20, an incomplete product or too large a sum
    (``invalid``); more than the stock with what the cart holds (``stock``); a 21st line
    (``cart_full``).  An action id gets its first result again, as long as it is among the
    cart's last 50.  With ``lines``: the carts of these owners afterwards (``owner, line,
    product_id, quantity, unit_amount``).

    ``carts``: ``owner, line, product_id, quantity, unit_amount``; ``locked``: ``owner``;
    ``proposals``: ``owner, occurred_at, event_id, action_id, product_id, quantity``; ``products``:
    ``product_id, title, stock, price``.
    """
    rows = _with_facts(carts, locked, proposals, products, ["action_id"])
    if lines:
        return fold_rows(rows, "owner", ["occurred_at", "event_id"], _cart, _propose, [], "line int, product_id long, quantity long, unit_amount long",
                         _final_lines)
    return fold_rows(rows, "owner", ["occurred_at", "event_id"], _cart, _propose, ["occurred_at", "event_id", "action_id", "product_id"],
                     "applied boolean, quantity_in_cart long, reason string")


def set_quantities(carts: DataFrame, locked: DataFrame, changes: DataFrame, products: DataFrame, lines: bool = False) -> DataFrame:
    """``owner, occurred_at, event_id, product_id, applied, reason`` of every change, in order.

    Refused: a cart with an open checkout, an unknown or incomplete product, a negative
    quantity, more than the stock unless it lowers what the cart holds, a 21st line.  0 takes
    the line out; another quantity keeps its place.  With ``lines``: the carts afterwards.
    """
    rows = _with_facts(carts, locked, changes, products, [])
    if lines:
        return fold_rows(rows, "owner", ["occurred_at", "event_id"], _cart, _set_quantity, [], "line int, product_id long, quantity long, unit_amount long",
                         _final_lines)
    return fold_rows(rows, "owner", ["occurred_at", "event_id"], _cart, _set_quantity, ["occurred_at", "event_id", "product_id"], "applied boolean, reason string")


# -------------------------------------------------------------------------- preferences
REMEMBER, FORGET, FORGET_ALL = "remember", "forget", "forget_all"


def _slot(n: int) -> str:
    return f"preference-{n:02}"


def start_preferences(row: dict | None = None) -> dict:
    return {}


def step_preferences(slots: dict, row: dict) -> dict:
    """One event: what became of it, and the slot it concerns."""
    def said(result: str, slot: int | None = None) -> dict:
        return {"result": result, "slot": _slot(slot) if slot else None}

    if row["action"] == FORGET_ALL:
        slots.clear()
        return said("forgotten_all")
    if row["action"] == FORGET:
        at = next((n for n in slots if _slot(n) == row["slot_key"]), None)
        if at is None:
            return said("not_found")
        del slots[at]
        return said("forgotten", at)
    if row["action"] != REMEMBER or row["refusal"]:
        return said(row["refusal"] or "unknown_action")
    known = next((n for n, v in slots.items() if v == (row["kind"], row["value"])), None)
    if known:
        return said("known", known)
    if len(slots) >= MAX_PREFERENCES:
        return said("full")
    free = next(n for n in range(1, MAX_PREFERENCES + 1) if n not in slots)
    slots[free] = (row["kind"], row["value"])
    return said("saved", free)


def _held_slots(slots: dict) -> list[dict]:
    return [{"slot": _slot(n), "kind": k, "value": v} for n, (k, v) in sorted(slots.items())]


def preference_refusal(kind: Column, value: Column) -> Column:
    """Why a preference may not be stored: ``personal_data`` (also injections) or
    ``invalid``; NULL if it may."""
    text = F.coalesce(value, F.lit(""))
    return (F.when(contains_pii(text) | detect_injection(text), "personal_data")
            .when(~F.coalesce(valid_preference(kind, F.btrim(text)), F.lit(False)), "invalid"))


def checked_preferences(events: DataFrame) -> DataFrame:
    """Events with trimmed values and the reason why a value may not be stored."""
    return events.select("owner", "occurred_at", "event_id", "action", "slot_key", "kind", F.btrim("value").alias("value"),
                         F.when(F.col("action") == REMEMBER, preference_refusal(F.col("kind"), F.col("value"))).alias("refusal"))


def preference_state(events: DataFrame, held: bool = False) -> DataFrame:
    """``owner, occurred_at, event_id, action, result, slot`` of every event in order of (``occurred_at,
    event_id``), or with ``held`` what each owner has at the end (``owner, slot, kind, value``).

    ``events``: ``owner, occurred_at, event_id, action`` (``remember``, ``forget``, ``forget_all``),
    ``slot_key, kind, value``.  Results: ``personal_data`` or ``invalid`` (not stored), ``known``
    (stored before), ``full`` (20 are stored), ``saved`` in the lowest free slot,
    ``forgotten``, ``not_found``, ``forgotten_all``.  Owners don't meet.
    """
    rows = checked_preferences(events)
    if held:
        return fold_rows(rows, "owner", ["occurred_at", "event_id"], start_preferences, step_preferences, [], "slot string, kind string, value string", _held_slots)
    return fold_rows(rows, "owner", ["occurred_at", "event_id"], start_preferences, step_preferences, ["occurred_at", "event_id", "action"], "result string, slot string")
