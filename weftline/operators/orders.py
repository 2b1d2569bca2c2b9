"""Flash-sale orders: validation, admission, decision, completion and recovery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.folders import stored
from weftline.functions.scalars import positive_id

LONG_MAX = 2**63 - 1
#: Parts into which the candidates for one item are dealt, so that a hot item is ranked by many tasks.
SALTS = 64


def validate_orders(orders: DataFrame) -> DataFrame:
    """Orders of strings (order_id, sku_id, user_id) as positive ids, with an error where one isn't; other columns stay, after the ids."""
    ids = {c: positive_id(F.col(c).cast("string")) for c in ("order_id", "sku_id", "user_id")}
    bad = F.lit(False)
    for x in ids.values():
        bad = bad | x.isNull()
    rest = [c for c in orders.columns if c not in ids]
    return orders.select(*[x.alias(c) for c, x in ids.items()], *rest, F.when(bad, "INVALID_ORDER").alias("err"))


def duplicate_purchases(orders: DataFrame) -> DataFrame:
    return orders.groupBy("sku_id", "user_id").agg(F.count("*").alias("duplicate_count")).where("duplicate_count > 1")


def conflicting_payloads(msgs: DataFrame) -> DataFrame:
    """Order ids that stand for several (sku, user)."""
    return msgs.groupBy("order_id").agg(F.count_distinct(F.struct("sku_id", "user_id")).alias("n_variants")).where("n_variants > 1")


def backlog(events: DataFrame, delivered: DataFrame, cap: int = 100_000) -> DataFrame:
    n = events.join(delivered.select("order_id"), "order_id", "left_anti").agg(F.count("*").alias("backlog"))
    return n.withColumn("is_full", F.col("backlog") >= cap)


def consume_stock(sku: DataFrame, decisions: DataFrame) -> DataFrame:
    used = decisions.where("status = 'CONFIRMED'").groupBy("sku_id").agg(F.count("*").alias("_used"))
    rows = sku.select(F.col("id").alias("sku_id"), F.col("stock").cast("long").alias("stock")).join(used, "sku_id", "left")
    return rows.select("sku_id", F.greatest(F.lit(0), F.col("stock") - F.coalesce("_used", F.lit(0))).cast("long").alias("stock"))


def release_stock(stock: DataFrame, transitions: DataFrame) -> DataFrame:
    """Stock after newly cancelled reservations, each counted once; beyond 64 bits is an error and changes nothing."""
    back = transitions.where("state = 'CANCELLED'").dropDuplicates(["order_id"]).groupBy("sku_id").agg(F.count("*").alias("_back"))
    total = F.try_add(F.col("stock"), F.coalesce("_back", F.lit(0)))
    return stock.join(back, "sku_id", "left").select(
        "sku_id", F.coalesce(total, "stock").alias("stock"), F.when(total.isNull(), "STOCK_OVERFLOW").alias("err")
    )


def _most(stock: DataFrame) -> int:
    """The largest stock of a table: no item has more winners. A constant in a plan, by which ranks are cut before rows are shuffled."""
    return max(0, stock.agg(F.max("stock")).first()[0] or 0)


def _winners(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The first row of each (sku_id, user_id) by ``order``, of those the first ``_stock`` of each item.

    A part of an item's users can hold no more winners than its stock, so only that many of each part
    meet in the last ranking. No stock is above ``most``.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("user_id"), F.lit(SALTS))).repartition("sku_id", "_salt")
    for name, keys, least in (("_first", ("sku_id", "_salt", "user_id"), F.lit(1)), ("_near", ("sku_id", "_salt"), F.col("_stock")), ("_rank", ("sku_id",), F.col("_stock"))):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        dealt = dealt.withColumn(name, rank).where((F.col(name) <= F.lit(1 if name == "_first" else most)) & (F.col(name) <= least))
    return dealt


def admit(requests: DataFrame, stock: DataFrame, buyers: DataFrame, reservations: DataFrame, cap: int = LONG_MAX, pending: int = 0) -> DataFrame:
    """Admission in order of arrival: ``order_id, result_order_id, result, err``.

    Requests: arrival, order_id, sku_id, user_id; stock: sku_id, stock (a malformed one is null or
    negative); buyers: sku_id, user_id; reservations: order_id, sku_id, user_id, state. In a batch
    stock only falls, so only a user's first request for an item can win: those are ranked by arrival
    and win while the rank is within the stock. Only candidates are ranked, at most one row per user. An order
    id belongs to its first request that is admitted; later requests under it for another item or buyer are a
    COLLISION, take no unit and leave their buyers free to ask again. ``stock_flow`` takes units that come back, too.
    """
    return admit_rows(requests, stock, buyers, reservations, cap, pending).select("order_id", "result_order_id", "result", "err")


def admit_rows(requests: DataFrame, stock: DataFrame, buyers: DataFrame, reservations: DataFrame, cap: int = LONG_MAX, pending: int = 0) -> DataFrame:
    """``admit`` with sku_id and user_id of each request."""
    r = requests.select("arrival", "order_id", "sku_id", "user_id")
    own = reservations.select("order_id", F.col("sku_id").alias("_sku"), F.col("user_id").alias("_user"))
    active = reservations.where("state in ('PENDING', 'CONFIRMED')").groupBy("sku_id", "user_id").agg(F.max("order_id").alias("_active"))
    left = stock.select("sku_id", F.col("stock").alias("_stock"), F.lit(True).alias("_has"))
    bought = buyers.select("sku_id", "user_id", F.lit(True).alias("_bought")).distinct()
    # One exchange of the requests for each key: ids that stand for several buyers or items are found where an id's reservation is.
    rows = r.join(own, "order_id", "left").withColumn("_several", _several_payloads())
    rows = rows.join(left, "sku_id", "left").join(active, ["sku_id", "user_id"], "left").join(bought, ["sku_id", "user_id"], "left")
    other = F.col("_sku").isNotNull() & ((F.col("_sku") != F.col("sku_id")) | (F.col("_user") != F.col("user_id")))
    early = (
        F.when(other, "COLLISION").when(F.col("_active").isNotNull(), "RETRY").when(F.col("_sku").isNotNull(), "ID_REUSED")
        .when(F.col("_bought"), "REJECTED").when(F.col("_has").isNull(), "REJECTED")
        .when(F.coalesce(F.col("_stock") < 0, F.lit(True)), "BAD_STOCK").when(F.col("_stock") == 0, "REJECTED")
    )
    rows = stored(rows.select(*PLACE, "_several", "_active", "_stock", early.alias("_early")))
    most = _most(stock)

    def win(candidates: DataFrame) -> DataFrame:
        return _winners(candidates, most, *PLACE).select(*PLACE, "_several")

    def capped(won: DataFrame) -> DataFrame:
        return won.orderBy(*PLACE).limit(max(0, cap - pending)) if cap < LONG_MAX else won

    if rows.where("_several").isEmpty():
        winners, all_rows = capped(win(rows.where("_early is null"))), rows
    else:
        winners, owners = _settle(rows.where("_early is null"), win, capped)
        shared = rows.where("_several").join(owners, "order_id", "left").withColumn("_early", F.when(_after_owner(), "COLLISION").otherwise(F.col("_early")))
        all_rows = rows.where("not _several").unionByName(shared.drop("_owner"))
    all_rows = all_rows.join(winners.select("sku_id", "user_id", F.col("order_id").alias("_won")), ["sku_id", "user_id"], "left")
    e, won = F.col("_early"), F.col("_won")
    errors = e.isin("COLLISION", "ID_REUSED", "BAD_STOCK")
    result = F.when(errors, "ERROR").when(e.isNotNull(), e).when(won == F.col("order_id"), "ADMITTED").when(won.isNotNull(), "RETRY").otherwise("REJECTED")
    return all_rows.select(
        "order_id", "sku_id", "user_id", F.when(e == "RETRY", F.col("_active")).when(e.isNull(), won).alias("result_order_id"), result.alias("result"), F.when(errors, e).alias("err")
    )


#: The order of requests of a batch.
PLACE = ("arrival", "order_id", "sku_id", "user_id")


def _after_owner() -> Column:
    """Whether a row comes after ``_owner``, the admitted request of its order id, and is of another buyer or item."""
    here = F.struct("arrival", "sku_id", "user_id")
    other = (F.col("_owner.sku_id") != F.col("sku_id")) | (F.col("_owner.user_id") != F.col("user_id"))
    return F.coalesce(other & (here > F.col("_owner")), F.lit(False))


def _several_payloads() -> Column:
    """Whether a row's order id stands for several buyers or items."""
    own = Window.partitionBy("order_id")
    return F.min(F.struct("sku_id", "user_id")).over(own) != F.max(F.struct("sku_id", "user_id")).over(own)


def _settle(candidates: DataFrame, win: Callable[[DataFrame], DataFrame], capped: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The winners where some order ids (``_several``) stand for several buyers or items, and each such id's admitted request.

    The first winner of an id keeps it, and the other requests after it go. That frees units and turns for later
    ones only, so a winner stays one or loses its id to an earlier winner, and what has gone never comes
    back: the rounds end, with what one request after another would give. An item's winners follow from its own
    candidates, so a round ranks only the items that have lost some; ``capped`` cuts all winners.
    """
    shared = candidates.where("_several")
    first = won = stored(win(candidates))
    gone = candidates.select(*PLACE).where("false")
    while True:
        winners = capped(won)
        owners = stored(winners.where("_several").groupBy("order_id").agg(F.min(F.struct("arrival", "sku_id", "user_id")).alias("_owner")))
        lost = shared.join(owners, "order_id").where(_after_owner()).select(*PLACE).distinct()
        more = stored(lost.join(gone, list(PLACE), "left_anti"))
        if more.isEmpty():
            return winners, owners
        gone = gone.unionByName(more)
        items = stored(gone.select("sku_id").distinct())
        again = stored(win(candidates.join(items, "sku_id", "left_semi").join(gone, list(PLACE), "left_anti")))
        won = first.join(items, "sku_id", "left_anti").unionByName(again)


def decide(msgs: DataFrame, orders: DataFrame, outcomes: DataFrame, sku: DataFrame) -> DataFrame:
    """Decisions of order messages in order of their ids: ``order_id, sku_id, user_id, status, keep_buyer, err``.

    A stored final outcome is repeated; an order of the same id confirms; another order of the user for
    the item cancels and keeps the buyer; without stock it is cancelled; else it is confirmed. Equal messages are one. Of
    an id's different ones the first by item and buyer counts, where nothing stored says which; each other one is a PAYLOAD_CONFLICT.
    """
    payload = F.struct("sku_id", "user_id")
    # One exchange of the messages for each key: an id's messages meet where they are made one, and its first is found there.
    m = msgs.select("order_id", "sku_id", "user_id").repartition("order_id").distinct().withColumn("_first", F.min(payload).over(Window.partitionBy("order_id")))
    said = outcomes.select("order_id", F.col("sku_id").alias("_osku"), F.col("user_id").alias("_ouser"), F.col("status").alias("_ostatus"), F.col("keep_buyer").alias("_okeep"))
    same = orders.select(F.col("id").alias("order_id"), F.col("sku_id").alias("_ssku"), F.col("user_id").alias("_suser"))
    prior = orders.groupBy("sku_id", "user_id").agg(F.min("id").alias("_prior"))
    left = sku.select(F.col("id").alias("sku_id"), F.col("stock").alias("_stock"))
    rows = m.join(said, "order_id", "left").join(same, "order_id", "left").join(left, "sku_id", "left").join(prior, ["sku_id", "user_id"], "left")

    def differs(a: str, b: str) -> Column:
        return F.col(a).isNotNull() & ((F.col(a) != F.col("sku_id")) | (F.col(b) != F.col("user_id")))

    final = F.col("_ostatus").isin("CONFIRMED", "CANCELLED")
    known = F.col("_osku").isNotNull() | F.col("_ssku").isNotNull()
    early = (
        F.when(differs("_osku", "_ouser") | (~F.coalesce(final, F.lit(False)) & differs("_ssku", "_suser")), "ERROR")
        .when(final, "STORED").when(F.col("_ssku").isNotNull(), "SAME").when(~known & (payload != F.col("_first")), "ERROR").when(F.col("_prior").isNotNull(), "PRIOR")
        .when(F.coalesce(F.col("_stock"), F.lit(0)) <= 0, "EMPTY")
    )
    rows = stored(rows.select("order_id", "sku_id", "user_id", "_ostatus", "_okeep", "_stock", early.alias("_early")))
    won = _winners(rows.where("_early is null"), _most(sku), "order_id").select("sku_id", "user_id", F.col("order_id").alias("_won"))
    e, by = F.col("_early"), F.col("_won")
    status = F.when(e == "STORED", F.col("_ostatus")).when(e == "SAME", "CONFIRMED").when(e == "ERROR", None).when(e.isNotNull(), "CANCELLED").when(by == F.col("order_id"), "CONFIRMED").otherwise("CANCELLED")
    keep = F.when(e == "STORED", F.col("_okeep")).when(e == "ERROR", None).when(e.isNotNull(), e.isin("SAME", "PRIOR")).otherwise(by.isNotNull())
    return rows.join(won, ["sku_id", "user_id"], "left").select(
        "order_id", "sku_id", "user_id", status.alias("status"), keep.alias("keep_buyer"), F.when(e == "ERROR", "PAYLOAD_CONFLICT").alias("err")
    )


#: Stocks nearer to the 64-bit limit than this are malformed for ``stock_flow``, which counts units back in.
ROOM = 1 << 40


def units_before(events: DataFrame, stock: DataFrame, block: str = "_block") -> DataFrame:
    """``events`` (sku_id, arrival, _move, a block number that rises with arrival) with ``_units``: the item's units before each event.

    A move of -1 takes a unit where there is one, +1 gives one back, 0 does nothing. Each event is a map of the stock
    of the form s -> max(s + a, b), and so are all events of a block together: blocks are summed up by
    themselves, their sums run on over the item's blocks, and each event adds what its own block holds before it. So
    an item's events are dealt over as many tasks as it has blocks. An item of a single block has number -1 for it, and needs no sums.
    Other columns of ``stock`` (sku_id, stock) come with its item's events.
    """
    here = Window.partitionBy("sku_id", block).orderBy("arrival")
    dealt = events.where(F.col(block) >= 0).select("sku_id", "arrival", "_move", block).withColumn("_sum", F.sum("_move").over(here))
    blocks = dealt.groupBy("sku_id", block).agg(F.sum("_move").alias("_total"), F.min("_sum").alias("_least"))
    past = Window.partitionBy("sku_id").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_total").over(past), F.lit(0)))
    blocks = blocks.withColumn("_floor", F.min(F.col("_base") + F.col("_least")).over(past)).select("sku_id", F.col(block).cast("int").alias(block), "_base", "_floor")
    left = stock.withColumnRenamed("stock", "_start")
    whole = left.select("sku_id", F.lit(-1).alias(block), F.lit(0).cast("long").alias("_base"), F.lit(None).cast("long").alias("_floor"), *left.columns[1:])
    items = blocks.join(left, "sku_id", "left").select(*whole.columns).unionByName(whole)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn(block, F.col(block).cast("int")).withColumn("_sum", F.sum("_move").over(here))
    rows = rows.withColumn("_prior", F.col("_sum") - F.col("_move")).withColumn("_dip", F.min("_sum").over(before)).join(items, ["sku_id", block], "left")
    base = F.coalesce("_base", F.lit(0))
    least = F.least(F.col("_floor"), base + F.col("_dip"))  # nulls are passed over
    units = base + F.col("_prior") + F.greatest(F.col("_start"), -least)
    return rows.withColumn("_units", units).drop("_sum", "_prior", "_dip", "_base", "_floor", "_start")


def _in_blocks(events: DataFrame, parts: int) -> DataFrame:
    """``events`` with ``_block``: -1, but for items of more than a ``parts``-th of all events a number that rises with arrival, up to ``parts`` of them."""
    sizes = stored(events.groupBy("sku_id").agg(F.count("*").alias("_n")))
    most = (sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] + parts - 1) // parts
    hot = sizes.where(F.col("_n") > most)
    if parts < 2 or hot.isEmpty():
        return events.withColumn("_block", F.lit(-1))
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    # Fewer items than ``parts`` are so large, and each has fewer cuts.
    cuts = events.join(F.broadcast(hot.select("sku_id")), "sku_id").groupBy("sku_id").agg(F.percentile_approx("arrival", shares).alias("_cuts"))
    number = F.size(F.filter("_cuts", lambda c: c < F.col("arrival")))
    return events.join(F.broadcast(stored(cuts)), "sku_id", "left").withColumn("_block", F.when(F.col("_cuts").isNull(), -1).otherwise(number)).drop("_cuts")


def stock_flow(events: DataFrame, stock: DataFrame, buyers: DataFrame, reservations: DataFrame, blocks: int | None = None) -> DataFrame:
    """Requests and outcomes of orders one after another: ``arrival, kind, order_id, sku_id, user_id, result_order_id, result, err``.

    Events: arrival (unique), kind REQUEST or OUTCOME, order_id, sku_id, user_id, and an outcome's status and
    keep_buyer. A request is admitted, repeated, rejected or an error as in ``admit``; an outcome is applied,
    unchanged or an error as in ``completions``. A cancellation gives its unit back to the requests that follow, and
    its buyer may ask again unless keep_buyer holds. Stocks null, negative or within ``ROOM`` of 64 bits are malformed.

    Rounds start from a guess of which events take effect, and each decides every event by what earlier ones do in
    the guess. A round is right for one event more than the guess at least, mostly for all whose forerunners it has right; the
    rounds end when one changes nothing. Only events that share their order id, or their item and buyer, with another (``_tied``)
    can have forerunners: only these are looked at for that, and moved for it.
    """
    parts = blocks or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = F.col("kind") == "REQUEST"
    e = _in_blocks(events.select("arrival", "kind", "order_id", "sku_id", "user_id", "status", "keep_buyer"), parts)
    stored_own = reservations.select("order_id", F.struct("sku_id", "user_id").alias("_held"), F.col("state").alias("_state"), F.col("keep_buyer").alias("_kept"))
    open_ = buyer_orders(reservations).withColumnRenamed("order_id", "_open")
    bought = buyers.select("sku_id", "user_id", F.lit(True).alias("_bought")).distinct()
    order, buyer = Window.partitionBy("order_id"), Window.partitionBy("sku_id", "user_id")
    e = e.join(stored_own, "order_id", "left").withColumn("_tied", F.count("*").over(order) > 1)
    e = e.join(open_, ["sku_id", "user_id"], "left").join(bought, ["sku_id", "user_id"], "left").withColumn("_tied", F.col("_tied") | (F.count("*").over(buyer) > 1))
    first = F.min(F.when(asked, F.col("arrival"))).over(buyer)
    e = stored(e.withColumn("_guess", F.when(asked & (first == F.col("arrival")), "ADMITTED")))
    good = (F.col("stock") >= 0) & (F.col("stock") <= LONG_MAX - ROOM)
    units = stock.select("sku_id", F.when(good, F.col("stock")).alias("stock"), F.lit(True).alias("_has"), F.coalesce(~good, F.lit(True)).alias("_bad"))
    tied, plain, guess = e.where("_tied"), e.where("not _tied").drop("_guess"), None
    while True:
        before = tied if guess is None else tied.drop("_guess").join(guess, "arrival", "left")
        new = stored(_flow_round(before.withColumnRenamed("_guess", "_did"), plain, units))
        after = new.where("_tied").select("arrival", F.when(F.col("result").isin("ADMITTED", "APPLIED"), F.col("result")).alias("_new"), F.col("_did").alias("_old"))
        if after.where(~F.col("_new").eqNullSafe(F.col("_old"))).isEmpty():
            return new.drop("_tied", "_did")
        guess = after.where("_new is not null").select("arrival", F.col("_new").alias("_guess"))


def _flow_round(tied: DataFrame, plain: DataFrame, stock: DataFrame) -> DataFrame:
    """What each event does, where the ``tied`` ones with ``_did`` took effect before it."""
    asked, cancels = F.col("kind") == "REQUEST", F.col("status") == "CANCELLED"
    payload = F.struct("sku_id", "user_id")
    # An order has one reservation and one end: the first of each.
    order, did = Window.partitionBy("order_id"), F.col("_did").isNotNull()
    began = F.min(F.when(did & asked, F.struct("arrival", payload.alias("payload")))).over(order)
    ended = F.min(F.when(did & ~asked, F.struct("arrival", "status", "keep_buyer"))).over(order)
    e = tied.withColumn("_began", began).withColumn("_ended", ended)
    # What the buyer's last effective event before left: an open order, or none and perhaps a mark.
    turn = F.when(did & asked, F.struct(F.col("order_id").alias("open"), F.lit(True).alias("marked")))
    turn = turn.when(did & cancels, F.struct(F.lit(None).cast("long").alias("open"), F.coalesce("keep_buyer", F.lit(False)).alias("marked")))
    past = Window.partitionBy("sku_id", "user_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_turn", F.last(turn, ignorenulls=True).over(past)).unionByName(plain, allowMissingColumns=True)
    after = lambda c: F.coalesce(F.col(f"{c}.arrival") < F.col("arrival"), F.lit(False))
    held = F.when(F.col("_held").isNotNull(), F.col("_held")).when(after("_began"), F.col("_began.payload"))
    state = F.when(after("_ended") & held.isNotNull(), F.col("_ended.status")).otherwise(F.coalesce("_state", F.lit("PENDING")))
    kept = F.when(after("_ended") & (F.col("_ended.status") == "CANCELLED"), F.col("_ended.keep_buyer")).otherwise(F.col("_kept"))
    open_ = F.when(F.col("_turn").isNotNull(), F.col("_turn.open")).otherwise(F.col("_open"))
    marked = F.when(F.col("_turn").isNotNull(), F.col("_turn.marked")).otherwise(F.coalesce("_bought", F.lit(False)))
    e = e.withColumn("_h", held).withColumn("_s", state).withColumn("_k", kept).withColumn("_o", open_).withColumn("_m", marked)
    foreign = F.col("_h").isNotNull() & (F.col("_h") != payload)
    request = F.when(foreign, "COLLISION").when(F.col("_o").isNotNull(), "RETRY").when(F.col("_h").isNotNull(), "ID_REUSED").when(F.col("_m"), "REJECTED")
    again = (F.col("_s") == F.col("status")) & (~cancels | F.col("_k").eqNullSafe(F.col("keep_buyer")))
    outcome = (
        F.when(F.col("_h").isNull(), "NO_RESERVATION").when(foreign, "OWNER_MISMATCH").when(F.col("_s") != "PENDING", F.when(again, "UNCHANGED").otherwise("STATE_CONFLICT"))
        .when(~F.col("_o").eqNullSafe(F.col("order_id")), "BUYER_ORDER_LOST").otherwise("APPLIED")
    )
    e = e.withColumn("_say", F.when(asked, request).otherwise(outcome))
    takes, gives = asked & F.col("_say").isNull(), ~asked & cancels & (F.col("_say") == "APPLIED")
    move = F.when(takes, -1).when(gives, 1).otherwise(0).cast("long")
    # What the item's stock is comes with its blocks; of an item without a good one no move counts.
    e = e.select("arrival", "kind", "order_id", "sku_id", "user_id", "_block", "_tied", "_did", "_say", F.when(F.col("_say") == "RETRY", F.col("_o")).alias("_own"), move.alias("_move"))
    e = units_before(e, stock)
    taken = F.when(F.col("_has").isNull(), "REJECTED").when(F.col("_bad"), "BAD_STOCK").when(F.col("_units") > 0, "ADMITTED").otherwise("REJECTED")
    say = F.when(F.col("_say").isNull(), taken).when((F.col("_move") > 0) & F.coalesce("_bad", F.lit(True)), "STOCK_ERROR").otherwise(F.col("_say"))
    e = e.withColumn("_say", say)
    errors = F.col("_say").isin("COLLISION", "ID_REUSED", "BAD_STOCK", "NO_RESERVATION", "OWNER_MISMATCH", "STATE_CONFLICT", "BUYER_ORDER_LOST", "STOCK_ERROR")
    own = F.when(F.col("_say") == "ADMITTED", F.col("order_id")).otherwise(F.col("_own"))
    return e.select("arrival", "kind", "order_id", "sku_id", "user_id", own.alias("result_order_id"), F.when(errors, "ERROR").otherwise(F.col("_say")).alias("result"), F.when(errors, F.col("_say")).alias("err"), "_tied", "_did")


def reservation_with_outcome(reservations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each outcome beside its reservation, with the reason why it can't be applied."""
    o = outcomes.select("order_id", F.col("sku_id").alias("o_sku_id"), F.col("user_id").alias("o_user_id"), "status", F.col("keep_buyer").alias("o_keep_buyer"))
    opposite = (F.col("state") != "PENDING") & (F.col("state") != F.col("status"))
    other_keep = (F.col("state") == "CANCELLED") & ~F.col("keep_buyer").eqNullSafe(F.col("o_keep_buyer"))
    err = (
        F.when(F.col("state").isNull(), "NO_RESERVATION")
        .when(~F.col("sku_id").eqNullSafe(F.col("o_sku_id")) | ~F.col("user_id").eqNullSafe(F.col("o_user_id")), "OWNER_MISMATCH")
        .when(opposite | other_keep, "STATE_CONFLICT")
    )
    return o.join(reservations, "order_id", "left").withColumn("err", err)


def buyer_orders(reservations: DataFrame) -> DataFrame:
    """The order that each (sku_id, user_id) has open: its last one that is pending or confirmed."""
    return reservations.where("state in ('PENDING', 'CONFIRMED')").groupBy("sku_id", "user_id").agg(F.max("order_id").alias("order_id"))


def one_outcome(outcomes: DataFrame) -> DataFrame:
    """An outcome of each order id: of the final ones the first by item, buyer, status and keep_buyer, whatever the rows' order."""
    final = outcomes.where("status in ('CONFIRMED', 'CANCELLED')")
    first = F.min(F.struct("sku_id", "user_id", "status", "keep_buyer")).alias("_first")
    return final.groupBy("order_id").agg(first).select("order_id", "_first.*")


def completions(reservations: DataFrame, stock: DataFrame, mapped: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What each outcome does to its reservation: ``order_id, sku_id, user_id, status, keep_buyer, result``.

    ``mapped`` has the open order of each buyer (sku_id, user_id, order_id). APPLIED changes a pending
    reservation, UNCHANGED finds it changed so already; else the result is an error, and nothing follows
    from it. An order that is no longer its buyer's open one is an error, and so is a cancellation for an item
    whose stock is missing, malformed or would leave 64 bits: in order of ids, the first ones that fit apply.
    Of an id's several outcomes ``one_outcome`` counts; one without a final status is none.
    """
    joined = reservation_with_outcome(reservations, one_outcome(outcomes))
    own = mapped.select(F.col("sku_id").alias("o_sku_id"), F.col("user_id").alias("o_user_id"), F.col("order_id").alias("_open"))
    left = stock.select(F.col("sku_id").alias("o_sku_id"), F.col("stock").alias("_stock"))
    rows = joined.join(own, ["o_sku_id", "o_user_id"], "left").join(left, "o_sku_id", "left")
    pending = F.col("state") == "PENDING"
    first = F.when(pending & ~F.col("_open").eqNullSafe(F.col("order_id")), "BUYER_ORDER_LOST")
    rows = rows.withColumn("err", F.coalesce("err", first))
    back = F.col("err").isNull() & pending & (F.col("status") == "CANCELLED")
    rows = rows.withColumn("_back", F.coalesce(back, F.lit(False)))
    # Only where the stock is so large that a batch could overflow it do its cancellations meet in one group.
    close = F.col("_back") & (F.col("_stock") > LONG_MAX - (1 << 40))
    place = F.row_number().over(Window.partitionBy("o_sku_id", "_back", F.when(close, F.lit(0)).otherwise(F.col("order_id"))).orderBy("order_id"))
    fits = F.coalesce((F.col("_stock") >= 0) & (F.col("_place") <= F.lit(LONG_MAX) - F.col("_stock")), F.lit(False))
    rows = rows.withColumn("_place", place).withColumn("err", F.when(F.col("_back") & ~fits, "STOCK_ERROR").otherwise(F.col("err")))
    result = F.when(F.col("err").isNotNull(), F.col("err")).when(pending, "APPLIED").otherwise("UNCHANGED")
    return rows.select("order_id", F.col("o_sku_id").alias("sku_id"), F.col("o_user_id").alias("user_id"), "status", F.col("o_keep_buyer").alias("keep_buyer"), result.alias("result"))


def after_completions(reservations: DataFrame, buyers: DataFrame, stock: DataFrame, mapped: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reservations, buyers, stock and buyers' open orders after ``completions``, of which only the applied ones count.

    A confirmation changes the state alone. A cancellation gives its unit back, closes the buyer's order and
    keeps the buyer's mark or takes it away; a mark to keep that is gone is set again.
    """
    applied = done.where("result = 'APPLIED'")
    changes = applied.select("order_id", F.col("status").alias("_status"), F.col("keep_buyer").alias("_keep"))
    new = reservations.join(changes, "order_id", "left").select(
        "order_id", "sku_id", "user_id", F.coalesce("_status", "state").alias("state"), F.when(F.col("_status") == "CANCELLED", F.col("_keep")).otherwise(F.col("keep_buyer")).alias("keep_buyer")
    )
    gone = applied.where("status = 'CANCELLED'")
    keep = F.coalesce("keep_buyer", F.lit(False))
    left = buyers.join(gone.where(~keep).select("sku_id", "user_id"), ["sku_id", "user_id"], "left_anti").select("sku_id", "user_id")
    again = gone.where(keep).select("sku_id", "user_id").join(buyers, ["sku_id", "user_id"], "left_anti")
    back = release_stock(stock, gone.withColumnRenamed("status", "state")).drop("err")
    return new, left.union(again), back, mapped.join(gone.select("order_id"), "order_id", "left_anti").select("sku_id", "user_id", "order_id")


def complete(reservations: DataFrame, buyers: DataFrame, stock: DataFrame, mapped: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reservations, buyers, stock and buyers' open orders after outcomes, and each outcome's ``completions``."""
    done = completions(reservations, stock, mapped, outcomes)
    return *after_completions(reservations, buyers, stock, mapped, done), done


def mark_applied(outcomes: DataFrame, done: DataFrame) -> DataFrame:
    final = F.col("status").isin("CONFIRMED", "CANCELLED")
    hit = outcomes.join(done.select("order_id", F.lit(True).alias("_done")).distinct(), "order_id", "left")
    return hit.withColumn("redis_applied", F.col("redis_applied") | (final & F.coalesce("_done", F.lit(False)))).drop("_done")


def postpone(outcomes: DataFrame, failed: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    hit = outcomes.join(failed.select("order_id", F.lit(True).alias("_failed")).distinct(), "order_id", "left")
    later = now + F.make_dt_interval(secs=F.lit(seconds))
    return hit.withColumn("next_retry_at", F.when(F.col("_failed"), later).otherwise(F.col("next_retry_at"))).drop("_failed")


def recovery_queue(outcomes: DataFrame, now: Column, n: int = 100) -> DataFrame:
    """The next final outcomes that aren't applied and are due."""
    due = outcomes.where(~F.col("redis_applied") & (F.col("next_retry_at") <= now) & F.col("status").isin("CONFIRMED", "CANCELLED"))
    return due.orderBy("next_retry_at", "order_id").limit(n)


def overdue(log: DataFrame, now: Column, idle_ms: int = 60_000, n: int = 100) -> DataFrame:
    """Undelivered entries that have been idle for ``idle_ms`` and more, the longest first."""
    idle = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("last_delivery").cast("timestamp"))
    return log.where(~F.col("delivered") & (idle >= idle_ms)).orderBy("last_delivery", "order_id").limit(n)


def order_history(msgs: DataFrame, orders: DataFrame) -> DataFrame:
    """Messages, each once, with whether an order of their id exists, and the first other order of the user for the item."""
    same = orders.select(F.col("id").alias("order_id"), F.lit(True).alias("same_id")).distinct()
    place = F.dense_rank().over(Window.partitionBy("sku_id", "user_id").orderBy("id"))
    first = orders.withColumn("_n", place).where("_n <= 2").groupBy("sku_id", "user_id").agg(F.min("id").alias("_one"), F.max("id").alias("_two"))
    joined = msgs.join(same, "order_id", "left").join(first, ["sku_id", "user_id"], "left")
    prior = F.when(F.col("_one") != F.col("order_id"), F.col("_one")).when(F.col("_two") != F.col("order_id"), F.col("_two"))
    return joined.select("order_id", "sku_id", "user_id", F.coalesce("same_id", F.lit(False)).alias("same_id"), prior.alias("prior_order_id"))


def run_recovery(outcomes: DataFrame, reservations: DataFrame, buyers: DataFrame, stock: DataFrame, mapped: DataFrame, now: Column, n: int = 100) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """One pass over the recovery queue: outcomes, reservations, buyers, stock and buyers' open orders after it.

    What applies or already holds is marked as applied; what fails is put off, so that it does not
    block the head of the queue.
    """
    *tables, done = complete(reservations, buyers, stock, mapped, recovery_queue(outcomes, now, n))
    failed = ~F.col("result").isin("APPLIED", "UNCHANGED")
    after = postpone(mark_applied(outcomes, done.where(~failed)), done.where(failed), now)
    return after, *tables
