"""Import graphs: resolution of relative imports, and cycles as strongly connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.folders import saved, scratch


def join_path(folder: Column, relative: Column) -> Column:
    """folder/relative with '.' and '..' resolved; null if it leaves the root or ends there, is absolute or holds a backslash."""
    parts = F.filter(F.concat(F.split(folder, "/"), F.split(relative, "/")), lambda p: ~p.isin("", "."))

    def step(state: Column, p: Column) -> Column:
        up = p == ".."
        stack = F.when(up, F.slice(state["stack"], 1, F.greatest(F.size(state["stack"]) - 1, F.lit(0)))).otherwise(F.concat(state["stack"], F.array(p)))
        return F.struct(stack.alias("stack"), (state["lost"] | (up & (F.size(state["stack"]) == 0))).alias("lost"))

    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(False).alias("lost"))
    return F.aggregate(parts, start, step, lambda s: F.when(~s["lost"] & (F.size(s["stack"]) > 0) & ~relative.startswith("/") & ~F.contains(relative, F.lit("\\")), F.array_join(s["stack"], "/")))


#: What may follow a specifier, in order of preference.
SCRIPT_ENDS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".d.ts")
MODULE_ENDS = (".py", ".pyi")
PACKAGE_ENDS = ("/__init__.py", "/__init__.pyi")
BARE = r"^(?:\.|(?:\.\./)*\.\./?)$"


def candidates(target: Column, kind: Column, bare: Column) -> Column:
    """Files that a resolved specifier may mean, in order of preference; an import of bare dots means a package's own file."""
    ends = lambda e: F.array(*(F.concat(target, F.lit(x)) for x in e))
    script = F.concat(F.array(target), ends(SCRIPT_ENDS), ends(tuple(f"/index{e}" for e in SCRIPT_ENDS)))
    return F.when(kind == "script", script).when(bare, ends(PACKAGE_ENDS)).otherwise(ends(MODULE_ENDS + PACKAGE_ENDS))


def family(path: Column) -> Column:
    return F.when(paths.language(path) == "python", "python").when(paths.language(path).isin("typescript", "javascript"), "script")


def resolved(imports: DataFrame, known: DataFrame) -> DataFrame:
    """imports (repo_id, src, kind, target, bare) with dst, the first candidate that is a known file (repo_id, low, kind, dst) of the same family.

    Files are never broadcast: their columns are small on disk and many times that in memory.
    """
    rows = imports.select("*", F.posexplode(candidates(F.col("target"), F.col("kind"), F.col("bare"))).alias("place", "low"))
    hit = rows.withColumn("low", F.lower("low")).join(known.hint("merge"), ["repo_id", "low", "kind"])
    return hit.groupBy(*imports.columns).agg(F.min_by("dst", "place").alias("dst"))


def edges(imports: DataFrame, files: DataFrame, submodules: DataFrame | None = None) -> DataFrame:
    """(repo_id, src, dst) of imports (repo_id, path, specifier) over files (repo_id, path, and the package's defined names where submodules are given): first candidate that exists, no self edges, one language family.

    submodules (repo_id, path, specifier) are names imported from bare dots: one is an
    edge to the module of that name, unless the package's own file, other than the
    importing one, defines the name.
    """
    first = F.min(F.struct(*(c for c in ("path", "defined") if c in files.columns)))
    known = files.withColumn("low", F.lower("path")).groupBy("repo_id", "low").agg(first.alias("f"))
    known = known.select("repo_id", "low", family(F.col("f.path")).alias("kind"), F.col("f.path").alias("dst"), *(["f.defined"] if "defined" in files.columns else []))

    def asked(rows: DataFrame) -> DataFrame:
        rows = rows.select("repo_id", F.col("path").alias("src"), "specifier", family(F.col("path")).alias("kind")).where(F.col("kind").isNotNull() & ((F.col("kind") == "python") | F.col("specifier").rlike(r"^\.\.?/")))
        return rows.withColumn("target", join_path(paths.directory(F.col("src")), F.col("specifier"))).withColumn("bare", F.col("specifier").rlike(BARE)).where("target is not null")

    names = known.drop("defined")
    out = resolved(asked(imports), names)
    if submodules is not None:
        rows = asked(submodules).where("kind = 'python'").withColumn("name", paths.basename(F.col("target"))).withColumn("package", paths.directory(F.col("target"))).where("package <> ''")
        package = resolved(rows.select("repo_id", "src", "kind", F.col("package").alias("target"), F.lit(True).alias("bare")).distinct(), names)
        own = package.select("repo_id", "src", F.col("target").alias("package"), F.col("dst").alias("init")).join(known.select("repo_id", F.col("dst").alias("init"), "defined").hint("merge"), ["repo_id", "init"])
        rows = rows.join(own.hint("merge"), ["repo_id", "src", "package"], "left")
        shadowed = (F.lower("init") != F.lower("src")) & F.array_contains("defined", F.col("name"))
        free = rows.where(~F.coalesce(shadowed, F.lit(False))).select("repo_id", "src", "specifier", "kind", "target", F.lit(False).alias("bare"))
        out = out.unionByName(resolved(free, names))
    return out.where("lower(src) <> lower(dst)").select("repo_id", "src", "dst").distinct()


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints need a folder that all executors share; local runs get one of this machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))


def _spread(graph: DataFrame, rounds: int) -> DataFrame:
    """(repo_id, node, f, b): the least label that reaches each node, and the least that it reaches, over edges (repo_id, u, v) of hashed nodes.

    Each node also points at a node that reaches it, at first a neighbour. A round takes
    the least label of the neighbours, of the node pointed at and of the label's own
    node, and then points where the node pointed at points: pointers double their way
    each round, so a path of any length takes rounds by its logarithm. Pointers that
    have run into a dead end, as where a path enters a ring, are set anew after so many
    rounds, at the neighbour with the least label. Labels are the nodes' hashes, in no
    order along a path. Rounds end when no label changes.
    """
    both = graph.select("repo_id", F.lit(0).alias("way"), "u", "v").unionByName(graph.select("repo_id", F.lit(1).alias("way"), F.col("v").alias("u"), F.col("u").alias("v")))
    both = saved(both, "cycle-edges")
    on = ["repo_id", "way"]
    nodes = both.select(*on, F.col("u").alias("node"), F.lit(None).cast("long").alias("u")).unionByName(both.select(*on, F.col("v").alias("node"), "u"))
    nodes = nodes.groupBy(*on, "node").agg(F.min("u").alias("at"))
    labels = saved(nodes.select(*on, "node", F.col("node").alias("label"), F.coalesce("at", "node").alias("at")), "labels")
    phase = labels.count().bit_length() + 1
    for turn in range(1, rounds + 1):
        step = both.join(labels.select(*on, F.col("node").alias("u"), "label").hint("merge"), [*on, "u"]).select(*on, F.col("v").alias("node"), "label", "u")
        nothing = F.lit(None).cast("long")
        least = labels.select(*on, "node", "label", F.col("label").alias("old"), "at", nothing.alias("u")).unionByName(step.withColumn("old", nothing).withColumn("at", nothing))
        at = F.coalesce(F.min_by("u", F.when(F.col("u").isNotNull(), F.col("label"))), F.max("at")) if turn % phase == 0 else F.max("at")
        least = least.groupBy(*on, "node").agg(F.min("label").alias("label"), F.max("old").alias("old"), at.alias("at"))
        by_label = labels.select(*on, F.col("node").alias("label"), F.col("label").alias("beyond"))
        by_pointer = labels.select(*on, F.col("node").alias("at"), F.col("label").alias("there"), F.col("at").alias("next"))
        new = least.join(by_label.hint("merge"), [*on, "label"]).join(by_pointer.hint("merge"), [*on, "at"])
        new = saved(new.select(*on, "node", F.least("label", "beyond", "there").alias("label"), F.col("at" if turn % phase == 0 else "next").alias("at"), "old"), "labels")
        labels = new.drop("old")
        if new.where("label <> old").isEmpty():
            break
    else:
        raise RuntimeError("labels did not settle")
    pick = lambda way: F.min(F.when(F.col("way") == way, F.col("label")))
    return labels.groupBy("repo_id", "node").agg(pick(0).alias("f"), pick(1).alias("b"))


def cycles(graph: DataFrame, rounds: int = 60) -> DataFrame:
    """(repo_id, component, members, size, place) of strongly connected components of two or more.

    Nodes whose least label forwards and backwards is the same are a component with
    the node of that label. Nodes of one component have both labels in common, so only
    edges between nodes with equal labels go on, under new labels, until none is left;
    acyclic parts fall apart in the first turn. place: larger components first, then by
    their members' paths; members go by lower case, then as they are.
    """
    spark = graph.sparkSession
    edges = saved(graph.select("repo_id", "src", "dst").where("src <> dst").distinct(), "cycle-graph")
    found = spark.createDataFrame([], f"repo_id {dict(graph.dtypes)['repo_id']}, node string, component string")
    for turn in range(rounds):
        if edges.isEmpty():
            break
        code = lambda c: F.xxhash64(F.lit(turn), "repo_id", c)  # noqa: E731, B023
        marks = _spread(edges.select("repo_id", code("src").alias("u"), code("dst").alias("v")), rounds)
        names = edges.select("repo_id", F.col("src").alias("node")).unionByName(edges.select("repo_id", F.col("dst").alias("node"))).distinct()
        marks = saved(names.select("repo_id", F.col("node").alias("name"), code("node").alias("node")).join(marks.hint("merge"), ["repo_id", "node"]), "marks")
        whole = marks.where("f = b").select("repo_id", F.col("name").alias("node"), F.concat(F.lit(f"{turn}:"), F.col("f")).alias("component"))
        found = found.unionByName(whole)
        side = lambda c: marks.where("f <> b").select("repo_id", F.col("name").alias(c), F.struct("f", "b").alias(f"{c}_mark")).hint("merge")  # noqa: E731, B023
        edges = saved(edges.join(side("src"), ["repo_id", "src"]).join(side("dst"), ["repo_id", "dst"]).where("src_mark = dst_mark").select("repo_id", "src", "dst"), "cycle-graph")
    else:
        raise RuntimeError("components did not settle")
    order = F.struct(F.lower("node").alias("low"), "node")
    out = found.groupBy("repo_id", "component").agg(F.array_sort(F.collect_list(order)).alias("own"), F.min("node").alias("least")).where(F.size("own") > 1)
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.size("own").desc(), "own"))
    return out.select("repo_id", F.col("least").alias("component"), F.col("own.node").alias("members"), F.size("own").alias("size"), place.alias("place"))
