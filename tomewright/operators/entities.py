"""People: alias table, person entries, mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright import fixed as K
from tomewright.functions import text as T
from tomewright.operators.automaton import SHARD_NAMES, find_names
from tomewright.session import cut_lineage


def _has_any(c: Column, words) -> Column:
    return c.rlike("|".join(words))


def table_aliases(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Aliases declared in alias tables: keys, alias, canonical (the first definition wins)."""
    head = F.transform(F.col("rows")[0], T.clean_cell)
    at = F.transform(head, lambda c, i: F.struct(
        i.alias("i"), _has_any(c, K.NAME_HEADERS).alias("name"), _has_any(c, K.ALIAS_HEADERS).alias("alias")))
    t = blocks.where("kind = 'table' and size(rows) > 1").select(*keys, "block_no", "rows", at.alias("_at"))
    t = t.select(*keys, "block_no", "rows",
                 F.array_min(F.transform(F.filter("_at", lambda x: x["name"]), lambda x: x["i"])).alias("_nc"),
                 F.transform(F.filter("_at", lambda x: ~x["name"] & x["alias"]), lambda x: x["i"]).alias("_ac")) \
        .where("_nc is not null")
    r = t.select(*keys, "block_no", "_nc", "_ac", F.posexplode_outer("rows").alias("row_no", "cells")) \
        .where("row_no > 0 and size(cells) > _nc")
    name = F.col("cells")[F.col("_nc")]
    r = r.where((name != "") & ~name.rlike(K.TABLE_RULE_CELL)).withColumn("canonical", T.clean_name_cell(name)) \
        .where("canonical <> ''")
    own = F.array(F.struct(F.lit(-1).alias("c"), F.lit(0).alias("p"), F.col("canonical").alias("a")))
    other = F.flatten(F.transform(F.filter("_ac", lambda i: i < F.size("cells")), lambda i: F.transform(
        T.alias_pieces(F.col("cells")[i]), lambda a, p: F.struct(i.alias("c"), p.alias("p"), a.alias("a")))))
    good = F.filter(other, lambda x: T.admissible_alias(x["a"]))
    rows = r.select(*keys, "canonical", "block_no", "row_no", F.explode_outer(F.concat(own, good)).alias("x"))
    return (rows.groupBy(*keys, F.col("x.a").alias("alias"))
            .agg(F.min_by("canonical", F.struct("block_no", "row_no", "x.c", "x.p")).alias("canonical")))


def _prefixes(c: Column) -> Column:
    n = F.length(c)
    return F.when(n >= K.MENTION_MIN_CHARS, F.transform(
        F.sequence(F.lit(K.MENTION_MIN_CHARS), F.greatest(n, F.lit(K.MENTION_MIN_CHARS))),
        lambda i: F.substring(c, F.lit(1), i)))


def _longest_prefix(heads: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block_no, pref: canonical of the longest known name that starts the title."""
    p = heads.select(*keys, "block_no", F.explode_outer(_prefixes(F.col("title"))).alias("alias")) \
        .where("alias is not null")
    return (p.join(names, [*keys, "alias"]).where("since < block_no").groupBy(*keys, "block_no")
            .agg(F.max_by("canonical", F.length("alias")).alias("pref")))


def _exact(heads: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    p = heads.select(*keys, "block_no", F.explode(F.array(
        F.struct(F.lit(0).alias("o"), F.col("title").alias("alias")),
        F.struct(F.lit(1).alias("o"), F.col("bare").alias("alias")))).alias("x")).select(*keys, "block_no", "x.*")
    return (p.join(names, [*keys, "alias"]).where("since < block_no").groupBy(*keys, "block_no")
            .agg(F.min_by("canonical", "o").alias("hit")))


def _block_text(k: Column) -> Column:
    def bullets(prefix):
        return F.array_join(F.transform("items", prefix), "\n")
    quoted = F.array_join(F.transform(T.lines_of(F.col("text")), lambda x: F.concat(F.lit("> "), x)), "\n")
    return (F.when(k == "ul", bullets(lambda x: F.concat(F.lit("- "), x)))
            .when(k == "ol", bullets(lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)))
            .when(k == "quote", quoted)
            .when(k == "slice", F.concat(F.lit("【原文·"), F.col("chapter"), F.lit("】\n"), quoted))
            .when(k == "table", F.array_join(F.transform("rows", lambda r: F.concat(
                F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n"))
            .when(k == "hr", F.lit("---")).otherwise(F.col("text")))


def people(blocks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(aliases, people) of people files given as block tables.

    A heading opens an entry when it names a known person, when it is level 3,
    or when a deeper heading starts with a known name; levels 1 and 2 close
    it.  Level-3 headings also add their name to the dictionary for the
    headings below them.
    """
    blocks = cut_lineage(blocks)        # read by every branch below
    table = table_aliases(blocks, keys)
    known = table.withColumn("since", F.lit(-1).cast("long"))
    title = T.ustrip(F.regexp_replace(F.col("text"), r"^\*+|\*+$", ""))
    heads = (blocks.where("kind = 'h'").withColumn("title", title)
             .withColumn("bare", T.ustrip(F.regexp_replace("title", K.PAREN_NOTE, "")))
             .withColumn("stop", _has_any(F.col("bare"), K.NON_PERSON_TITLES))
             .select(*keys, "block_no", "level", "title", "bare", "stop"))
    at = [*keys, "block_no"]
    own = F.when(F.col("bare") != "", F.col("bare")).otherwise(F.col("title"))
    fresh = (heads.where("level = 3 and not stop").join(_exact(heads, known, keys), at, "left_anti")
             .join(_longest_prefix(heads, known, keys), at, "left_anti")
             .groupBy(*keys, own.alias("alias")).agg(F.min("block_no").alias("since")))
    # a name that continues an earlier one belongs to that person
    longer = (fresh.select(*keys, F.col("alias").alias("title"), F.col("since").alias("block_no"))
              .withColumn("alias", F.explode_outer(_prefixes(F.col("title")))).where("alias <> title")
              .join(fresh, [*keys, "alias"]).where("since < block_no")
              .select(*keys, F.col("title").alias("alias")).distinct())
    fresh = fresh.join(longer, [*keys, "alias"], "left_anti").withColumn("canonical", F.col("alias"))
    names = known.unionByName(fresh.select(*known.columns))
    heads = heads.join(_exact(heads, names, keys), at, "left").join(_longest_prefix(heads, names, keys), at, "left")
    opens = (F.when(F.col("hit").isNotNull(), F.col("hit"))
             .when(((F.col("level") == 3) & ~F.col("stop")) | ((F.col("level") >= 4) & F.col("pref").isNotNull()),
                   F.coalesce("pref", own)))
    opens = F.nullif(opens, F.lit(""))
    turn = F.when(opens.isNotNull() | (F.col("level") <= 2), F.struct(opens.alias("name"), F.col("block_no").alias("at")))
    b = blocks.join(heads.select(*at, turn.alias("turn"), "title"), at, "left")
    w = Window.partitionBy(*keys).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("cur", F.last("turn", True).over(w)).where("turn is null and cur.name is not null")
    md = F.when(F.col("kind") == "h", F.concat(F.lit("### "), F.col("title"))).otherwise(_block_text(F.col("kind")))
    bodies = (b.select(*keys, F.col("cur.name").alias("canonical"), F.col("cur.at").alias("opened"),
                       "block_no", md.alias("md"))
              .groupBy(*keys, "canonical", "opened")
              .agg(T.ustrip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "md"))),
                                                     lambda x: x["md"]), "\n")).alias("body"))
              .where("body <> ''"))
    entries = bodies.groupBy(*keys, "canonical").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("opened", "body"))), lambda x: x["body"]), "\n\n").alias("body"))
    return names.select(*keys, "alias", "canonical"), entries


def merge_aliases(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two alias dictionaries; the first definition wins."""
    return (first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
            .groupBy(*keys, "alias").agg(F.min_by("canonical", "_p").alias("canonical")))


def linkable(aliases: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Aliases whose person has an entry."""
    return aliases.join(entries.select(*keys, "canonical").distinct(), [*keys, "canonical"], "left_semi")


def unlinked_people(aliases: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Canonical names of the dictionary without an entry."""
    return aliases.select(*keys, "canonical").distinct().join(
        entries.select(*keys, "canonical"), [*keys, "canonical"], "left_anti")


def people_index(aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Aliases listed per person."""
    return aliases.groupBy(*keys, "canonical").agg(
        F.array_join(F.array_sort(F.collect_set("alias")), " ").alias("aliases"),
        F.count("*").alias("n_aliases"))


def mentions(texts: DataFrame, aliases: DataFrame, key: str, place: list[str], text: str = "text",
             shard_names: int = SHARD_NAMES, first_only: bool = False) -> DataFrame:
    """Mentions in reading order, leftmost-longest and non-overlapping: place, ord, alias, canonical.

    ``place`` starts with ``key``.  Texts carry no dictionary: they stream past
    an automaton that names the canonical (several where a dictionary exceeds
    ``shard_names``), so nothing found is joined.  ``first_only`` keeps the first
    mention of each canonical in a row of ``texts``.
    """
    names = (aliases.where(F.length("alias") >= K.MENTION_MIN_CHARS).groupBy(key, "alias")
             .agg(F.min("canonical").alias("canonical")))
    return find_names(texts, names, key, place, text, shard_names, ["canonical"], "canonical" if first_only else None)


def first_mentions(found: DataFrame, unit: list[str], order: list[str]) -> DataFrame:
    """First mention of each person per unit: a minimum, combined before the shuffle."""
    return (found.groupBy(*unit, "canonical").agg(F.min(F.struct(*order, "alias")).alias("_m"))
            .select(*unit, "canonical", *[F.col(f"_m.{o}").alias(o) for o in order], F.col("_m.alias").alias("alias")))


def people_warnings(books: DataFrame, aliases: DataFrame, entries: DataFrame, slices: DataFrame) -> DataFrame:
    """Flags per book: no dictionary, no entries, people without entry, no quotation."""
    def has(df, name):
        return df.groupBy("book_id").agg(F.count("*").alias(name))
    un = unlinked_people(aliases, entries, ["book_id"])
    out = books.select("book_id").distinct()
    for df, name in ((aliases, "aliases"), (entries, "entries"), (un, "unlinked"), (slices, "slices")):
        out = out.join(has(df, name), "book_id", "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("aliases", "entries", "unlinked", "slices")}
    return out.select("book_id", (n["aliases"] == 0).alias("no_aliases"),
                      ((n["aliases"] > 0) & (n["entries"] == 0)).alias("no_entries"),
                      n["unlinked"].alias("unlinked"), (n["slices"] == 0).alias("no_slices"))
