"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source) triples; tokens are white-space words.
A total budget flows down the tree: at every node it is divided among the
children by weight, a child gets at most what its leaves can supply (their
tokens times ``epochs``), and what a child cannot take is divided among its
siblings, again by weight, before any of it returns to the parent's siblings.
:func:`shares` divides at all nodes of a level at once by running sums over the
children in the order of their shortage; :func:`budgets` is the same rule for a
few leaves in memory, written plainly, and what the tests compare it with.

A leaf of budget b then takes whole epochs and a prefix of the next: each epoch
orders the leaf's documents by a hash of (seed, epoch, id), and documents are
taken in this order while the tokens before them are under b. A leaf may hold
any share of the corpus: its order is cut ``LEVELS`` times into ``1 << BITS``
ranges of the hash, at each level only range sums are ordered, and only the one
range in which the budget ends is looked into further.

Texts are tokenised once: ids, leaves and counts are kept in the shared folder.
The last places chosen, a row per leaf and epoch, are broadcast up to
``MAX_BROADCAST`` of them; above, leaves of over a thousandth of all rows are
(1,000 at most, by arithmetic) and all others are joined by the leaf.

Defined cases: null text has no tokens; a text without tokens is chosen where
its place lies before the last chosen one of its leaf; null domain, language or
source form a leaf of their own; a weight that is absent is 1, a weight of 0
gives nothing; without documents or tokens nothing is chosen; equal hashes are
ordered by id, then by a hash of the text; rows that repeat id and text are
chosen together; rows with a null id have the place of their text; columns are
carried through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, materialize, skew_join, text_of

#: A leaf's order is cut into 2 ** BITS ranges, the one in which the budget ends into as many again, LEVELS times.
BITS, LEVELS = 8, 3
#: Rows of a few words each that are broadcast at most.
MAX_BROADCAST = 100_000
PATH = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The domain of a source: its name without the trailing number's last digit, e.g. src1x for src17."""
    return F.regexp_replace(source, "[0-9]$", "x")


def divide(total: float, wants: Mapping, weights: Mapping) -> dict:
    """Divide ``total`` by weight, none above its ``wants``; shortages go to the others by weight."""
    got, open_, left = dict.fromkeys(wants, 0.0), [k for k in wants if weights.get(k, 1.0) > 0 and wants[k] > 0], total
    while open_ and left > 1e-9:
        scale = left / sum(weights.get(k, 1.0) for k in open_)
        full = [k for k in open_ if wants[k] <= weights.get(k, 1.0) * scale]
        if not full:
            for k in open_:
                got[k] = weights.get(k, 1.0) * scale
            break
        for k in full:
            got[k] = wants[k]
            left -= wants[k]
        open_ = [k for k in open_ if k not in full]
    return got


def budgets(supply: Mapping[tuple, float], total: float, weights: Mapping[tuple, float]) -> dict[tuple, float]:
    """The budget of every leaf. supply: tokens a leaf can give; weights: of any node, by its path."""

    def room(prefix: tuple, leaves: list[tuple]) -> float:
        """What the leaves can take, those under a weight of 0 aside."""
        return sum(supply[x] for x in leaves if all(weights.get(x[:i], 1.0) > 0 for i in range(len(prefix) + 1, len(x) + 1)))

    def down(prefix: tuple, leaves: list[tuple], amount: float) -> dict[tuple, float]:
        at = len(prefix)
        if leaves == [prefix]:
            return {prefix: amount}
        children: dict[tuple, list[tuple]] = {}
        for x in leaves:
            children.setdefault(x[: at + 1], []).append(x)
        share = divide(amount, {c: room(c, some) for c, some in children.items()}, {c: weights.get(c, 1.0) for c in children})
        return {k: v for c, some in children.items() for k, v in down(c, some, share[c]).items()}

    return down((), sorted(supply, key=repr), total) if supply else {}


def tokens(text: Column) -> Column:
    """White-space words, as the gaps between them."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(inner) == 0, F.lit(0)).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def _same(left: str, right: str, columns: tuple[str, ...]) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return found


def weighted(leaves: DataFrame, weights: Mapping[tuple, float]) -> DataFrame:
    """``leaves`` with the weights of their nodes at each level: w0, w1 ...; 1 where none is stated."""
    out = leaves
    for i in range(len(PATH)):
        found = F.lit(1.0)
        for path, weight in weights.items():
            if len(path) == i + 1:
                here = F.lit(True)
                for c, v in zip(PATH, path):
                    here = here & F.col(c).eqNullSafe(F.lit(v))
                found = F.when(here, F.lit(float(weight))).otherwise(found)
        out = out.withColumn(f"w{i}", found)
    return out


def shares(leaves: DataFrame, total: float, weights: Mapping[tuple, float]) -> DataFrame:
    """(domain, lang, source, supply, budget) of every leaf. leaves: their path and ``supply``."""
    levels = len(PATH)
    open_ = F.col("supply").cast("double")
    each = weighted(leaves, weights)
    # what a node can take: the supply of the leaves that no weight of 0 below or at it closes
    rooms = [None] * levels
    for i in reversed(range(levels)):
        open_ = F.when(F.col(f"w{i}") > 0, open_).otherwise(0.0)
        rooms[i] = open_
    each = materialize(each.withColumns({f"room{i}": rooms[i] for i in range(levels)}))
    above = None
    for i in range(levels):
        names = PATH[: i + 1]
        nodes = each.groupBy(*names).agg(F.sum(f"room{i}").alias("want"), F.first(f"w{i}").alias("w"))
        if above is None:
            nodes = nodes.withColumn("amount", F.lit(float(total)))
        else:
            nodes = nodes.alias("n").join(above.alias("a"), _same("n", "a", PATH[:i])).select("n.*", F.col("a.got").alias("amount"))
        above = _divided(nodes, names).select(*names, "got")
        if i < levels - 1:
            above = materialize(above)
    return each.alias("l").join(above.alias("a"), _same("l", "a", PATH)).select(*[F.col(f"l.{c}").alias(c) for c in PATH], "l.supply", F.col("a.got").alias("budget"))


def _divided(nodes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``nodes`` with got: their part of the parent's ``amount`` by weight ``w``, none above its ``want``.

    Children that lack most for their weight come first. One gets its whole
    want if that is under its weight's part of what those before it leave; the
    others get weight parts of the rest.
    """
    parent = names[:-1]
    takes = F.col("w") * F.col("want") > 0
    turn = [F.try_divide(F.col("want"), F.col("w")), *map(F.col, names)]
    # both frames begin where their order does, and so grow by a row at a time
    before = Window.partitionBy(*parent, takes).orderBy(*turn).rowsBetween(Window.unboundedPreceding, -1)
    to_last = Window.partitionBy(*parent, takes).orderBy(*[c.desc() for c in turn]).rowsBetween(Window.unboundedPreceding, 0)
    level = F.try_divide(F.greatest(F.col("amount") - F.coalesce(F.sum("want").over(before), F.lit(0.0)), F.lit(0.0)), F.sum("w").over(to_last))
    some = nodes.withColumn("level", F.when(takes, level)).withColumn("short", takes & (F.col("want") <= F.col("w") * F.col("level")))
    # beyond the first child that is not short, the level only falls
    rest = F.max(F.when(takes & ~F.col("short"), F.col("level"))).over(Window.partitionBy(*parent))
    return some.withColumn("got", F.when(~takes, 0.0).when(F.col("short"), F.col("want")).otherwise(F.col("w") * rest))


def place(seed: int, epoch: Column, id_col: Column, mark: Column) -> Column:
    """The place of a document in an epoch: a hash of its id, or of its text's hash where it has none."""
    return F.when(id_col.isNull(), F.xxhash64(F.lit(seed), epoch, mark)).otherwise(order_of(seed, epoch, id_col))


def order_of(seed: int, epoch: Column, id_col: Column) -> Column:
    """The place of a document that has an id."""
    return F.xxhash64(F.lit(seed), epoch, id_col)


def mix(docs: DataFrame, share: float | None = 0.5, total: float | None = None, weights: Mapping[tuple, float] | None = None, epochs: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The chosen rows with their columns, one more row for each further epoch.

    total: tokens to choose; or ``share`` of all tokens at hand.
    """
    domain = domain_of(F.col(source_col)) if domain is None else domain
    own = [f"c{i}" for i in range(len(docs.columns))]
    # from here on no name of the input can clash with one of these
    base = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own)], domain.alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(id_col).alias("id"))
    text = text_of(own[docs.columns.index(text_col)])
    base = base.withColumns({"leaf": F.to_json(F.struct(*PATH), {"ignoreNullFields": "false"}), "mark": F.xxhash64(text)})
    small = materialize(base.select(*PATH, "leaf", "id", "mark", tokens(text).alias("t")))
    leaves = materialize(small.groupBy(*PATH, "leaf").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("rows")))
    all_tokens, all_rows, n = leaves.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    hot = hot_keys(leaves, "leaf", "rows", all_rows)
    want = total if total is not None else share * all_tokens
    plan = shares(leaves.select(*PATH, (F.col("t") * epochs).alias("supply")), want, weights or {})
    plan = plan.alias("p").join(leaves.alias("l"), _same("p", "l", PATH)).select("l.leaf", "l.t", "p.budget")
    each = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    mine = F.least(F.greatest(F.col("budget") - F.col("epoch") * F.col("t"), F.lit(0.0)), F.col("t").cast("double"))
    each = materialize(each.select("leaf", "epoch", mine.alias("budget")).where("budget > 0"))
    bounded = n * epochs <= MAX_BROADCAST

    def with_leaves(rows: DataFrame, of_leaf: DataFrame) -> DataFrame:
        """Each row beside the rows of its leaf in ``of_leaf``, of which a leaf has one per epoch at most."""
        return rows.join(F.broadcast(of_leaf), "leaf") if bounded else skew_join(rows, of_leaf, "leaf", hot)

    cut = cuts(small.select("leaf", "id", "mark", "t"), each, seed, with_leaves)
    found = with_leaves(base.drop(*PATH), cut)
    here = F.struct(place(seed, F.col("epoch"), F.col("id"), F.col("mark")).alias("h"), "id", "mark")
    # in a struct's order nulls come first, and equal those of another struct
    return found.where(here <= F.col("last")).select(*own).toDF(*docs.columns)


def cuts(small: DataFrame, plan: DataFrame, seed: int, with_leaves) -> DataFrame:
    """(leaf, epoch, last): the place, id and text mark of the last that is chosen of each leaf and epoch.

    plan: (leaf, epoch, budget).
    """
    keys = ["leaf", "epoch"]
    rows = with_leaves(small.where("t > 0"), plan).withColumn("h", place(seed, F.col("epoch"), F.col("id"), F.col("mark")))
    ends = plan.select(*keys, "budget", F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        # the hash's leading bits name the range; those of the level above are the range that was found there
        ranged = rows.withColumn("range", F.shiftright("h", 64 - BITS * level))
        sums = ranged.groupBy(*keys, "range").agg(F.sum("t").alias("t"))
        sums = sums.join(ends.select(*keys, F.col("budget").alias("b"), F.col("before").alias("ahead")), keys)
        w = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        placed = sums.withColumn("before", F.col("ahead") + F.coalesce(F.sum("t").over(w), F.lit(0))).where("before < b")
        # the range in which the budget ends, or the last one: the last that begins under the budget
        ends = placed.groupBy(*keys).agg(F.max_by("range", "range").alias("range"), F.max_by("before", "range").alias("before"), F.first("b").alias("budget"))
        ends = materialize(ends)
        found = with_leaves(ranged.drop("budget").withColumnsRenamed({"epoch": "e", "range": "r"}), ends.select("leaf", "epoch", "range"))
        rows = found.where((F.col("e") == F.col("epoch")) & (F.col("r") == F.col("range"))).select("leaf", "epoch", "id", "mark", "t", "h")
    units = rows.groupBy(*keys, "h", "id", "mark").agg(F.sum("t").alias("t"))
    units = units.join(ends.select(*keys, "budget", "before"), keys)
    w = Window.partitionBy(*keys).orderBy("h", "id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    chosen = units.withColumn("ahead", F.col("before") + F.coalesce(F.sum("t").over(w), F.lit(0))).where("ahead < budget")
    return chosen.groupBy(*keys).agg(F.max(F.struct("h", "id", "mark")).alias("last"))
