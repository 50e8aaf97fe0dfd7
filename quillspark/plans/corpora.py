"""Markdown corpora made from the base tables: doc_id and source, one document a row of the key table.

They let every operator run at any scale with answers that SQL can work out from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gathered(rows: DataFrame, key: str, order: list[Column], line: Column, separator: str = "\n", name: str = "body") -> DataFrame:
    """doc_id and the lines of each key in order; partial lists combine before the shuffle."""
    pairs = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], line.alias("line"))))
    return rows.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.array_join(F.transform(pairs, lambda x: x["line"]), separator).alias(name))


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region each: # region, ## nation, ### supplier."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    heads = nation.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), F.lit(-1).cast("long").alias("s"), text("## ", F.col("n_name")).alias("line"))
    subs = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), F.col("s_suppkey").alias("s"), text("### ", F.col("s_name")).alias("line"))
    top = region.select(F.col("r_regionkey").alias("r"), F.lit(-1).alias("n"), F.lit(-1).cast("long").alias("s"), text("# ", F.col("r_name")).alias("line"))
    docs = gathered(top.union(heads).union(subs), "r", [F.col("n"), F.col("s")], F.col("line"), "\n\n", "source")
    return docs


def pipe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region each: a table of nations."""
    rows = gathered(table(spark, sf_dir, "nation"), "n_regionkey", [F.col("n_nationkey")], text("| ", F.col("n_name"), " | ", F.col("n_nationkey"), " |"))
    return rows.select("doc_id", text("| Nation | Key |\n|:---|---:|\n", F.col("body"), "\n").alias("source"))


def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer each: a task an order, checked when it is finished."""
    mark = F.when(F.col("o_orderstatus") == "F", "x").otherwise(" ")
    return gathered(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderkey")], text("- [", mark, "] order ", F.col("o_orderkey")), name="source")


def reference_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer each: a paragraph with a reference an order, then definitions; every third has none, every fifth an unused one."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    uses = gathered(orders, "o_custkey", [k], text("See [order ", k, "][o", k, "] first."), "\n")
    own = F.when(k % 3 != 0, text("[o", k, "]: https://orders.example/", k, "\n")).otherwise("")
    extra = F.when(k % 5 == 0, text("[u", k, "]: https://unused.example/", k, "\n")).otherwise("")
    defs = gathered(orders, "o_custkey", [k], F.concat(own, extra), "", "defs")
    return uses.join(defs, "doc_id").select("doc_id", text(F.col("body"), "\n\n\n", F.col("defs")).alias("source"))


def footnoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order each: a reference a line; every fourth line number has no definition."""
    items, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    refs = gathered(items, "l_orderkey", [n, F.col("l_partkey")], text("part ", F.col("l_partkey"), "[^n", n, "]"), " ")
    defs = gathered(items.where(n % 4 != 0).select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", [n], text("[^n", n, "]: note ", n), "\n", "defs")
    return refs.join(defs, "doc_id", "left").select("doc_id", text(F.col("body"), "\n\n", F.coalesce("defs", F.lit("")), "\n").alias("source"))


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part each: a container named for its size."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("note", "details", "gadget", "column"))), (F.col("p_size") % 4 + 1).cast("int"))
    brand = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    return p.select(F.col("p_partkey").cast("long").alias("doc_id"), text(":::", kind, ' "', F.col("p_name"), '" {#p', F.col("p_partkey"), " .", brand, ' data="', F.col("p_size"), '"}\nSize ', F.col("p_size"), ".\n:::\n").alias("source"))


def admonitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order each: an admonition by the digit of its priority, with a lazy line."""
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("IMPORTANT", "WARNING", "NOTE", "TIP", "CAUTION"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(F.col("o_orderkey").cast("long").alias("doc_id"), text("> [!", kind, "] Order ", F.col("o_orderkey"), "\n> status ", F.col("o_orderstatus"), "\nlazy line\n").alias("source"))


# A host for each remainder of the part key.
HOSTS = ("youtube.com/watch?v=", "youtu.be/", "vimeo.com/", "github.com/a/", "twitter.com/b/", "spotify.com/track/", "soundcloud.com/c/", "media.example/clip.mp4?x=", "example.org/page/", "codepen.io/d/")


def embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    host = F.element_at(F.array(*map(F.lit, HOSTS)), (k % 10 + 1).cast("int"))
    return p.select(k.cast("long").alias("doc_id"), text("[[embed:https://", host, k, "]]\n").alias("source"))


def fronted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer each: frontmatter and one line."""
    c = table(spark, sf_dir, "customer")
    version = F.when(F.col("c_custkey") % 7 == 0, "0.2").otherwise("0.1")
    return c.select(F.col("c_custkey").cast("long").alias("doc_id"), text("---\ntitle: ", F.col("c_name"), '\nsegment: "', F.col("c_mktsegment"), '"\nmdpp: ', version, "\n---\nCustomer ", F.col("c_custkey"), ".\n").alias("source"))


# A fence language for each remainder of the part key.
LANGUAGES = ("python", "Mermaid", "sequence", "Go", "c4", "sql")


def fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), (k % 6 + 1).cast("int"))
    return p.select(k.cast("long").alias("doc_id"), text("```", language, "\ngantt\n  part ", k, "\n```\n").alias("source"))


def skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order each: a heading a line, its level from the line number and quantity, so that levels skip and titles repeat."""
    items, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    level = (F.col("l_quantity").cast("int") % 4 + 1).cast("int")
    return gathered(items, "l_orderkey", [n, F.col("l_partkey"), F.col("l_quantity")], text(F.expr("repeat('#', cast(cast(l_quantity as int) % 4 + 1 as int))"), " Flag ", F.col("l_returnflag"), " ", level), "\n\n", "source")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they are."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("source"))


def untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation each: what the formatter has to put right."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("doc_id"), text(F.col("n_name"), "\n=====\n\n\n\n* key ", F.col("n_nationkey"), "\n* __region__ ", F.col("n_regionkey"), "\n\n~~~SQL\nselect 1;\n~~~\n## End ##\n").alias("source"))
