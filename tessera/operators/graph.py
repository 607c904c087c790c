"""Graph analytics over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def clamp_depth(depth: float | None, default: int = 3, most: int = 10) -> int:
    """default for a depth that is missing, not a number or not positive; at most ``most``."""
    if depth is None or depth != depth or depth <= 0:
        return default
    return min(int(depth), most)


def closure(edges: DataFrame, start: DataFrame, depth: int | None = 3, limit: int | None = None) -> DataFrame:
    """node, depth, parent, path: nodes reached from ``start`` (node) along edges source -> target, each at its least depth.

    Level by level: a level is one join on the frontier and one anti-join on
    what is reached, so the work is bounded by edges x depth and no path is
    listed twice; the distinct edges are written once.  Of several parents the smallest path wins; start nodes are
    not in the result.  The frontier's lineage is cut at every level.
    """
    from tessera.sources import lineage

    edges = lineage.cut(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct())
    reached = frontier = start.select("node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.array("node").alias("path")).distinct()
    for level in range(1, clamp_depth(depth) + 1):
        step = edges.join(frontier, edges["source"] == frontier["node"])
        step = step.groupBy(F.col("target").alias("node")).agg(F.min(F.struct(F.col("path"), F.col("source"))).alias("_best"))
        step = step.join(reached.select("node"), "node", "left_anti")
        frontier = lineage.cut(step.select("node", F.lit(level).alias("depth"), F.col("_best.source").alias("parent"), F.concat("_best.path", F.array("node")).alias("path")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    out = reached.where("depth > 0")
    return out if limit is None else out.orderBy("depth", "path").limit(limit)


def impact(edges: DataFrame, root: int, depth: int | None = 3, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes that depend on root, and a one-row summary (total, truncated, deepest); root must be a node id."""
    spark = edges.sparkSession
    reverse = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    found = closure(reverse, spark.createDataFrame([(root,)], "node long"), depth, limit + 1)
    summary = found.agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("total"), (F.count(F.lit(1)) > limit).alias("truncated"), F.max("depth").alias("deepest"))
    return found.orderBy("depth", "path").limit(limit), summary


def by_depth(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"), F.array_sort(F.collect_list("node")).alias("nodes"))


def edge_statistics(calls: DataFrame) -> DataFrame:
    """Per called symbol: incoming, unresolved, artifact_self_loops and resolved_elsewhere.

    calls: caller, callee (null: unresolved), symbol, call_line, root (the
    symbol's own definition), root_line.  A self loop on the definition's own
    line is an artefact.
    """
    artefact = (F.col("caller") == F.col("root")) & (F.col("callee") == F.col("root")) & (F.col("call_line") == F.col("root_line"))
    return calls.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("incoming"), F.count_if(F.col("callee").isNull()).alias("unresolved"),
        F.count_if(F.coalesce(artefact, F.lit(False))).alias("artifact_self_loops"), F.count_if(F.col("callee").isNotNull() & (F.col("callee") != F.col("root"))).alias("resolved_elsewhere"),
    )


def functions_with_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """id, calls_to, called_by: rows of calls that start in a function, and rows whose called symbol has its name.

    functions: id, name; calls: source, symbol.  Each side is counted before
    it is joined, so that no call is listed once for each call of the other side.
    """
    out = calls.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("calls_to"))
    called = calls.groupBy(F.col("symbol").alias("name")).agg(F.count(F.lit(1)).alias("called_by"))
    both = functions.join(out, "id", "left").join(called, "name", "left")
    return both.select("id", F.coalesce("calls_to", F.lit(0)).alias("calls_to"), F.coalesce("called_by", F.lit(0)).alias("called_by"))


def without_artefacts(calls: DataFrame) -> DataFrame:
    """One row for each (caller, symbol) with its first line, unless all its rows are self loops on the definition's line."""
    loop = F.coalesce((F.col("caller") == F.col("callee")) & (F.col("call_line") == F.col("line_start")), F.lit(False))
    return calls.groupBy("caller", "symbol").agg(F.min("callee").alias("callee"), F.min("call_line").alias("call_line"), F.bool_and(loop).alias("_loop")).where("NOT _loop").drop("_loop")


def shortest_path(edges: DataFrame, source: int, target: int, depth: int = 10) -> DataFrame:
    """One row with the path from source to target (the smallest of the shortest), none if there is no path."""
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([([source],)], "path array<long>")
    return closure(edges, spark.createDataFrame([(source,)], "node long"), depth).where(F.col("node") == target).select("path")


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    """node, direction: callers and callees (or dependents and dependencies) one step away."""
    out = edges.where(F.col("source") == node).select(F.col("target").alias("node"), F.lit("out").alias("direction"))
    return out.union(edges.where(F.col("target") == node).select(F.col("source").alias("node"), F.lit("in").alias("direction"))).where("node IS NOT NULL").distinct()


def cycle_members(edges: DataFrame) -> DataFrame:
    """node, cycle: nodes that can reach themselves, and the smallest node of their strongly connected component.

    Nodes without a way in or out are trimmed first; then colours (largest
    node that reaches) and backward reachability within a colour peel off
    components until no edge is left; each round removes one at least.
    """
    from tessera.sources import lineage

    own = edges.where("source = target").select(F.col("source").alias("node")).distinct()
    left = lineage.cut(edges.select("source", "target").where("source <> target AND source IS NOT NULL AND target IS NOT NULL").distinct())
    found = own.select("node", F.col("node").alias("cycle"))
    while True:
        before = None
        while True:  # trim
            n = left.count()
            if n == before:
                break
            before = n
            inner = left.select(F.col("source").alias("_n")).intersect(left.select(F.col("target").alias("_n")))
            left = left.join(inner, left["source"] == inner["_n"], "left_semi")
            left = lineage.cut(left.join(inner, left["target"] == inner["_n"], "left_semi"))
        if not before:
            break
        colour = _spread(left, left.select(F.col("source").alias("node")).distinct().withColumn("colour", F.col("node")))
        same = left.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("c1")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("c2")), "target").where("c1 = c2")
        reverse = lineage.cut(same.select(F.col("target").alias("source"), F.col("source").alias("target"), "c1"))
        member = _reach(reverse, colour.where("node = colour").select("node", "colour"))
        sizes = member.groupBy("colour").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("cycle"))
        component = lineage.cut(member.join(sizes, "colour").select("node", "cycle", "_n"))
        found = found.union(component.where("_n > 1").select("node", "cycle"))
        gone = component.select(F.col("node").alias("_n2"))
        left = left.join(gone, left["source"] == gone["_n2"], "left_anti")
        left = lineage.cut(left.join(gone, left["target"] == gone["_n2"], "left_anti"))
    return found.groupBy("node").agg(F.min("cycle").alias("cycle"))


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Largest colour that reaches each node."""
    from tessera.sources import lineage

    state = None
    while True:
        sent = edges.join(colour, edges["source"] == colour["node"]).select(F.col("target").alias("node"), "colour")
        colour = lineage.cut(colour.union(sent).groupBy("node").agg(F.max("colour").alias("colour")))
        now = colour.agg(F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)"))).first()
        if now == state:
            return colour
        state = now


def _reach(reverse: DataFrame, member: DataFrame) -> DataFrame:
    """Nodes reached within their colour from its root."""
    from tessera.sources import lineage

    frontier = member = lineage.cut(member)
    while not frontier.isEmpty():
        step = reverse.join(frontier, (reverse["source"] == frontier["node"]) & (reverse["c1"] == frontier["colour"])).select(F.col("target").alias("node"), "colour").distinct()
        frontier = lineage.cut(step.join(member.select("node"), "node", "left_anti"))
        member = lineage.cut(member.union(frontier))
    return member


def call_tree(edges: DataFrame, roots: DataFrame, depth: int = 2, most: int = 300) -> DataFrame:
    """key, parent_key, node, depth, cycle: the callee tree of each root, flattened; a node that its own path holds ends the branch.

    depth is 1 to 4.  Rows are ordered by depth and key before the cap, and a
    row comes after its parent's, so a level needs no more than the first
    ``most`` rows of the one above to be expanded, and gives no more itself.
    """
    from tessera.sources import lineage

    edges = edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct()
    level = roots.select(F.array("node").alias("path"), "node", F.lit(False).alias("cycle"))
    key = lambda path: F.array_join(F.transform(path, lambda x: x.cast("string")), "/")
    tree = level.select(key(F.col("path")).alias("key"), F.lit(None).cast("string").alias("parent_key"), "node", F.lit(0).alias("depth"), "cycle")
    for d in range(1, max(1, min(depth, 4)) + 1):
        open_nodes = level.where("NOT cycle").select("path", "node")
        level = open_nodes.join(edges, open_nodes["node"] == edges["source"]).select(F.concat("path", F.array("target")).alias("path"), F.col("target").alias("node"), F.array_contains("path", F.col("target")).alias("cycle"))
        level = lineage.cut(level.orderBy(key(F.col("path"))).limit(most))
        tree = tree.union(level.select(key(F.col("path")), key(F.slice("path", 1, d)), "node", F.lit(d), "cycle"))
    return tree.orderBy("depth", "key").limit(most)


def pick_candidate(candidates: DataFrame) -> DataFrame:
    """One definition for each (caller, symbol): the only one in the caller's file, else the only one, else the smallest, flagged ambiguous.

    candidates: caller, symbol, caller_file, candidate, candidate_file.
    """
    same = F.col("candidate_file") == F.col("caller_file")
    got = candidates.groupBy("caller", "symbol").agg(F.count_if(same).alias("_same"), F.min(F.when(same, F.col("candidate"))).alias("_own"), F.count(F.lit(1)).alias("_all"), F.min("candidate").alias("_first"))
    return got.select("caller", "symbol", F.when(F.col("_same") == 1, F.col("_own")).otherwise(F.col("_first")).alias("candidate"), ((F.col("_same") != 1) & (F.col("_all") > 1)).alias("ambiguous"))


def file_dependencies(imports: DataFrame) -> DataFrame:
    """source, target, dependency_count, dependency_types: distinct import tuples between different files.

    imports: source, target, symbol, import_type, line.
    """
    rows = imports.where("target IS NOT NULL AND source <> target").select("source", "target", "symbol", "import_type", "line").distinct()
    return rows.groupBy("source", "target").agg(F.count(F.lit(1)).alias("dependency_count"), F.array_sort(F.collect_set("import_type")).alias("dependency_types"))


def dependency_strength(imports: DataFrame, calls: DataFrame) -> DataFrame:
    """source, target, strength: twice the imports and once the calls from file to file."""
    i = imports.groupBy("source", "target").agg((F.count(F.lit(1)) * 2).alias("weight"))
    c = calls.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    return i.unionByName(c).groupBy("source", "target").agg(F.sum("weight").alias("strength"))


def import_statistics(imports: DataFrame) -> DataFrame:
    """files, imports, avg_imports, avg_imports_import_weighted (each import row counts its file's number), max_imports."""
    per_file = imports.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("imports"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("avg_imports"),
        F.round(F.coalesce(F.sum(F.col("n") * F.col("n")) / F.sum("n"), F.lit(0.0)), 6).alias("avg_imports_import_weighted"), F.coalesce(F.max("n"), F.lit(0)).alias("max_imports"),
    )


def latest_by_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def file_graph(files: DataFrame, imports: DataFrame, calls: DataFrame, root: int, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, path) of the files within depth - 1 imports of a file, and their edges (source, target, type, weight).

    files: id, path; imports: source, target; calls: source, target (files).
    One edge of weight 1 for each import with a file and each call into another
    file; ends of edges at the rim are no nodes.
    """
    start = files.sparkSession.createDataFrame([(root,)], "node long")
    inside = start if depth <= 1 else start.union(closure(imports, start, depth - 1).select("node"))
    inside = inside.join(files.select(F.col("id").alias("node")), "node", "left_semi")
    nodes = files.join(inside, files["id"] == inside["node"], "left_semi").select("id", F.regexp_extract("path", "([^/]*)$", 1).alias("label"), "path")
    ends = imports.where("target IS NOT NULL").select("source", "target", F.lit("imports").alias("type"))
    ends = ends.union(calls.where("target IS NOT NULL AND target <> source").select("source", "target", F.lit("calls")))
    return nodes, ends.join(inside, ends["source"] == inside["node"], "left_semi").withColumn("weight", F.lit(1))


def symbol_tree(definitions: DataFrame, calls: DataFrame, symbol: str, chunk: int | None = None, depth: int | None = 2, direction: str = "both", most: int = 400) -> DataFrame:
    """direction, depth, key, parent_key, node, symbol, path, call_line, ambiguous, candidates, cyclic: who calls a symbol and what it calls, flattened.

    definitions: id, symbol, path, line_start; calls: source, target, symbol,
    call_line.  The root is the definition ``chunk`` of the symbol, else the
    first by place; without a definition there are no rows.  A callee is the
    only definition of the called name in the caller's file, else the first by
    place (ambiguous, if there are more); a name without one is a row without
    node.  Of several callers with one name the smallest id stays.  Nodes that
    their own path holds are cyclic and end a branch, calls of a definition's
    own line to itself are left out.  At most ``most`` rows: callers first, by
    depth and key; each level expands no more, so frontiers are of that size.
    """
    from tessera.sources import lineage

    d = definitions.select("id", "symbol", "path", "line_start")
    place = F.struct("path", "line_start", "id")
    own = d.where(F.col("symbol") == symbol)
    root = own.agg(F.min_by(F.struct("id", "symbol", "path"), F.struct(F.col("id") != F.lit(chunk), place) if chunk is not None else place).alias("_r"), F.count(F.lit(1)).alias("candidates")).where("candidates > 0")
    root = lineage.cut(root.select("_r.id", "_r.symbol", "_r.path", "candidates"))
    columns = ["direction", "depth", "key", "parent_key", "node", "symbol", "path", "call_line", "ambiguous", "candidates", "cyclic"]
    none = lambda kind: F.lit(None).cast(kind)
    tree = root.select(F.lit("root").alias("direction"), F.lit(0).alias("depth"), F.lit("root").alias("key"), none("string").alias("parent_key"), F.col("id").cast("long").alias("node"), "symbol", "path", none("long").alias("call_line"), (F.col("candidates") > 1).alias("ambiguous"), F.col("candidates").cast("long").alias("candidates"), F.lit(False).alias("cyclic"))
    loop = F.coalesce((F.col("source") == F.col("target")) & (F.col("symbol") == F.col("_own")) & (F.col("call_line") == F.col("line_start")), F.lit(False))
    edges = calls.join(d.select(F.col("id").alias("source"), F.col("symbol").alias("_own"), F.col("path").alias("_path"), "line_start"), "source")
    for way in ("callers", "callees") if direction == "both" else (direction,):
        level = root.select(F.lit(way[:-1]).alias("key"), F.col("id").cast("long").alias("node"), "symbol", "path", F.array(F.col("id").cast("long")).alias("_up"))
        for n in range(1, clamp_depth(depth, 2, 4) + 1):
            open_nodes = F.broadcast(level.select(F.col("key").alias("parent_key"), F.col("node").alias("_node"), F.col("symbol").alias("_symbol"), F.col("path").alias("_file"), "_up"))
            if way == "callers":
                pairs = edges.join(open_nodes, F.col("symbol") == F.col("_symbol")).groupBy("parent_key", "_up", "source", "_own", "_path").agg(F.min("call_line").alias("call_line"), F.bool_and(loop).alias("_loop")).where("NOT _loop AND _own <> ''")
                step = pairs.groupBy("parent_key", "_up", F.col("_own").alias("symbol")).agg(F.min_by(F.struct(F.col("source").alias("node"), F.col("_path").alias("path"), "call_line"), "source").alias("_c"))
                step = step.select("parent_key", "_up", F.col("_c.node").cast("long").alias("node"), "symbol", "_c.path", F.col("_c.call_line").cast("long").alias("call_line"), F.lit(False).alias("ambiguous"), F.lit(1).cast("long").alias("candidates"))
            else:
                pairs = edges.join(open_nodes, F.col("source") == F.col("_node")).groupBy("parent_key", "_up", "_file", "symbol").agg(F.min("call_line").alias("call_line"), F.bool_and(loop).alias("_loop")).where("NOT _loop AND symbol IS NOT NULL")
                named = pairs.select("symbol").distinct()
                places = d.join(named, "symbol").groupBy("symbol", "path").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_p"))
                every = places.groupBy("symbol").agg(F.sum("_n").alias("_all"), F.min("_p").alias("_first"))
                step = pairs.join(every, "symbol", "left").join(places.where("_n = 1").select("symbol", F.col("path").alias("_file"), F.col("_p").alias("_same")), ["symbol", "_file"], "left")
                pick = F.coalesce("_same", "_first")
                step = step.select("parent_key", "_up", pick["id"].cast("long").alias("node"), "symbol", pick["path"].alias("path"), F.col("call_line").cast("long").alias("call_line"), (F.col("_same").isNull() & (F.coalesce("_all", F.lit(0)) > 1)).alias("ambiguous"), F.coalesce("_all", F.lit(0)).cast("long").alias("candidates"))
            step = step.withColumns({"key": F.concat("parent_key", F.lit("."), "symbol"), "cyclic": F.coalesce(F.array_contains("_up", F.col("node")), F.lit(False))})
            step = lineage.cut(step.orderBy("key", "node").limit(most))
            tree = tree.union(step.withColumns({"direction": F.lit(way), "depth": F.lit(n)}).select(*columns))
            level = step.where("node IS NOT NULL AND NOT cyclic").select("key", "node", "symbol", "path", F.concat("_up", F.array("node")).alias("_up"))
    first = F.when(F.col("direction") == "root", 0).when(F.col("direction") == "callers", 1).otherwise(2)
    return tree.orderBy(first, "depth", "key").limit(most)


def question_tree(definitions: DataFrame, calls: DataFrame, question: str, evidence: tuple[str, ...] = (), depth: int | None = 2, direction: str | None = None) -> tuple[dict, DataFrame | None]:
    """What a question about calls asks for (direction, tokens, matched_by, root, alternatives), and the tree of its symbol; no tree without one.

    The root is the first definition of the first name of the question that
    has any, in either case; else of the first symbol of the evidence.
    """
    from tessera.functions import questions
    from tessera.operators import search

    spark = definitions.sparkSession
    asked = spark.createDataFrame([(question,)], "q string").select(questions.call_direction(F.col("q")).alias("way"), questions.symbol_tokens(F.col("q")).alias("tokens")).first()
    way, tokens = direction or asked["way"], list(asked["tokens"])
    names = list(dict.fromkeys([*tokens, *(x.strip() for x in evidence if x.strip())]))
    found: dict = {}
    if names:
        rows = search.named_symbols(definitions, names).withColumn("_k", F.lower("symbol"))
        firsts = rows.groupBy("_k").agg(F.min(F.struct("symbol", "path", "line_start", "id")).alias("_f"))  # one row a name of the question
        found = {r["_k"]: r["_f"] for r in firsts.collect()}
    roots = list(dict.fromkeys(found[t.lower()] for t in tokens if t.lower() in found))
    matched = "query-token" if roots else "none"
    if not roots and evidence and evidence[0].strip().lower() in found:
        roots, matched = [found[evidence[0].strip().lower()]], "evidence-top"
    about = {"direction": way, "tokens": tokens, "matched_by": matched, "root": roots[0].asDict() if roots else None, "alternatives": [r.asDict() for r in roots[1:]]}
    if not roots:
        return about, None
    return about, symbol_tree(definitions, calls, roots[0]["symbol"], roots[0]["id"], depth, way)
