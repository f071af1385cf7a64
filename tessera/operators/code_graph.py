"""Tables of a code base: bindings, edges of thirteen kinds, where names come from, and evidence for symbols.

All are keyed by (project_id, path of the file). Files meet by path, symbols by equality within a project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import modules as M
from ..functions import paths as P
from ..functions import text as X
from .graph import pair_tests
from .joins import resolve_imports
from .lineage import cut

#: What an imported file is to the file that imports it: the first row that it fits by kind, role, folder, piece of its
#: path or ending counts. Fixed values.
EDGE_KINDS = [
    ("style-import", ["style"], ["style"], [], [], []),
    ("hook-import", [], ["hook"], ["hooks"], [], []),
    ("service-import", [], ["service"], ["service", "services", "controller", "controllers", "handler", "handlers"], [], []),
    ("utility-import", [], ["utility"], ["utils", "utilities", "helpers", "lib"], [], []),
    ("client-api-import", [], ["client-api"], ["client", "clients"], ["/src/api/"], [f"/{n}.{e}" for n in ("api", "client") for e in ("ts", "tsx", "js", "jsx", "mjs", "cjs")]),
    ("storage-import", [], ["repository", "storage"], ["storage", "repository", "repositories", "db", "data"], [], []),
    ("types-import", [], ["types", "schema", "db-schema"], ["types", "schemas", "schema"], [], [".d.ts", ".schema.ts", ".schema.js", ".sql"]),
    ("component-import", [], ["component", "ui-component"], [], [], []),
]
#: Words that may follow or precede a symbol in the name of its owner. Fixed values.
TECHNICAL = ["page", "component", "service", "route", "handler", "controller", "hook", "store", "context", "provider", "modal", "repository", "adapter", "client"]
#: Folders and endings of files that own the fields of contracts, and roles of such files. Fixed values.
CONTRACT_ROLES = ["api-route", "client-api", "types", "schema", "db-schema"]
CONTRACT_FOLDERS = ["route", "routes", "api", "type", "types", "schema", "schemas"]
CONTRACT_ENDS = [".d.ts", ".schema.ts", ".schema.js"]
#: Kinds of evidence, the best first. Fixed values.
EVIDENCE = ["symbol_exact", "route_graph", "state_graph", "reference_graph", "content_supported", "model_only", "rank_only"]


def bindings(files: DataFrame) -> DataFrame:
    """(project_id, src, module, imported, local, kind, type_only, pos) of ``files(project_id, path, content)``.

    A row for each name that a file imports or hands on; ``pos`` is its place in the file. Null contents have none.
    """
    found = files.select("project_id", F.col("path").alias("src"), F.posexplode(M.statements(F.col("content"))).alias("at", "statement"))
    names = found.select("project_id", "src", M.module_of(F.col("statement")).alias("module"), "at", F.posexplode(M.bindings_of(F.col("statement"))).alias("k", "b"))
    return names.select("project_id", "src", "module", "b.imported", "b.local", "b.kind", "b.type_only", F.struct("at", "k").alias("pos"))


def specifiers(files: DataFrame) -> DataFrame:
    """(project_id, src, specifier): every module that a file names, by statement, call or style sheet, once each."""
    text = F.col("content")
    calls = lambda p: F.regexp_extract_all(M.without_comments(text), F.lit(p), 1)
    named = F.concat(F.transform(M.statements(text), M.module_of), calls(M.CALLS), calls(M.STYLES))
    trimmed = F.array_distinct(F.filter(F.transform(named, lambda s: F.trim(s)), lambda s: s != ""))
    return files.select("project_id", F.col("path").alias("src"), F.explode(trimmed).alias("specifier"))


def edge_kind(src: Column, dst: Column, kind: Column, role: Column) -> Column:
    """What ``dst``, of a kind and role, is to ``src``."""
    low = F.lower(dst)
    folders = F.split(P.directory(low), "/")
    out = F
    for name, kinds, roles, within, pieces, ends in EDGE_KINDS:
        fits = kind.isin(kinds) | role.isin(roles) | F.arrays_overlap(folders, X.strings(*within))
        for piece in pieces:
            fits = fits | F.contains(F.concat(F.lit("/"), low), F.lit(piece))
        for end in ends:
            fits = fits | F.endswith(F.concat(F.lit("/"), low), F.lit(end))
        out = out.when(F.coalesce(fits, F.lit(False)), name)
    home = P.directory(src)
    return out.when((home != "") & F.startswith(low, F.concat(F.lower(home), F.lit("/"))), "route-local").otherwise("import")


def edges(files: DataFrame) -> DataFrame:
    """(project_id, src, dst, module, kind): the graph of ``files(project_id, path, kind, role, content)``.

    Imports that lead to a file have a kind by what that file is; a test and the file it tests are joined by
    ``test-target`` and ``proposed-test`` (no module); every edge has its reverse, ``imported-by``.
    """
    targets = files.select("project_id", F.col("path").alias("dst"), F.col("kind").alias("dst_kind"), "role")
    found = resolve_imports(files.select("project_id", "path"), specifiers(files)).join(targets, ["project_id", "dst"])
    imports = found.select("project_id", "src", "dst", F.col("specifier").alias("module"), edge_kind(F.col("src"), F.col("dst"), F.col("dst_kind"), F.col("role")).alias("kind"))
    pairs = pair_tests(files.select("project_id", "path"))
    none = F.lit(None).cast("string").alias("module")
    tests = pairs.select("project_id", F.col("test").alias("src"), F.col("source").alias("dst"), none, F.lit("test-target").alias("kind"))
    proposed = pairs.select("project_id", F.col("source").alias("src"), F.col("test").alias("dst"), none, F.lit("proposed-test").alias("kind"))
    ahead = imports.unionByName(tests).unionByName(proposed)
    return ahead.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back")).select(
        "project_id", F.when(F.col("back"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("back"), F.col("src")).otherwise(F.col("dst")).alias("dst"),
        "module", F.when(F.col("back"), "imported-by").otherwise(F.col("kind")).alias("kind"),
    )


def resolve_names(bound: DataFrame, resolved: DataFrame, declared: DataFrame) -> DataFrame:
    """(project_id, src, local, file, name, hops): where the names that files import are declared.

    ``bound``: the columns of ``bindings``; ``resolved``: (project_id, src, specifier, dst); ``declared``: (project_id,
    file, name). An imported name is looked up in its module's file; if that file hands it on from another module under
    this or another name, the trail goes on there. Trails are shortened by pointer jumping: each round joins every
    pointer with the pointer at its end, so that a trail of n files takes log n rounds. Names whose trail leaves the
    inventory, ends without a declaration or goes in a circle are left out, as are whole modules. ``hops`` counts the
    files handed through.
    """
    # both are asked twice, and made of whole texts
    at = cut(bound.filter("imported <> '*'").join(resolved.select("project_id", "src", F.col("specifier").alias("module"), "dst"), ["project_id", "src", "module"]))
    own = cut(declared.select("project_id", "file", "name").distinct())
    # of several exports of one name the first by place counts, and a declaration of the file's own before all
    handed = at.filter("kind = 'reexport'").groupBy("project_id", F.col("src").alias("file"), F.col("local").alias("name")).agg(F.min_by(F.struct("dst", "imported"), "pos").alias("to"))
    handed = handed.join(own, ["project_id", "file", "name"], "left_anti")
    trail = cut(handed.select("project_id", "file", "name", F.col("to.dst").alias("to_file"), F.col("to.imported").alias("to_name"), F.lit(1).cast("long").alias("hops")))
    rounds = max(1, trail.count().bit_length())
    for _ in range(rounds):
        ends = trail.select("project_id", F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.col("to_file").alias("end_file"), F.col("to_name").alias("end_name"), F.col("hops").alias("more"))
        step = trail.join(ends, ["project_id", "to_file", "to_name"], "left")
        trail = cut(step.select(
            "project_id", "file", "name", F.coalesce("end_file", "to_file").alias("to_file"), F.coalesce("end_name", "to_name").alias("to_name"),
            (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("end_file").isNotNull().alias("moved"),
        ))
        if trail.filter("moved").isEmpty():
            break
        trail = trail.drop("moved")
    trail = trail.select("project_id", "file", "name", "to_file", "to_name", "hops")
    asked = at.select("project_id", "src", "local", F.col("dst").alias("file"), F.col("imported").alias("name"))
    met = asked.join(trail, ["project_id", "file", "name"], "left")
    last = met.select("project_id", "src", "local", F.coalesce("to_file", "file").alias("file"), F.coalesce("to_name", "name").alias("name"), F.coalesce("hops", F.lit(0)).alias("hops"))
    return last.join(own, ["project_id", "file", "name"], "left_semi").groupBy("project_id", "src", "local").agg(F.min(F.struct("hops", "file", "name")).alias("m")).select(
        "project_id", "src", "local", "m.file", "m.name", "m.hops"
    )


def query_symbols(tasks: DataFrame, most: int = 48) -> DataFrame:
    """(task_id, project_id, symbol, pos): the symbols that ``tasks(task_id, project_id, raw_task)`` name.

    Identifiers of four characters or more in canonical form, and all words of a text of five words or less joined;
    symbols under four characters are left out.
    """
    text = F.col("raw_task")
    named = F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z0-9_$])([A-Za-z_$][A-Za-z0-9_$]{3,})"), 1), X.canonical_symbol)
    words = X.tokenize_identifier(text)
    joined = F.when(F.size(words).between(1, 5), F.array(F.array_join(words, ""))).otherwise(X.strings())
    symbols = F.slice(F.array_distinct(F.filter(F.concat(named, joined), lambda s: F.length(s) >= 4)), 1, most)
    return tasks.select("task_id", "project_id", F.posexplode(symbols).alias("pos", "symbol"))


def suffix_owners(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """(task_id, project_id, symbol, file, declaration): files that declare a symbol with technical words around it.

    ``asked``: (task_id, project_id, symbol); ``facts``: (project_id, file, kind, name). Taken are symbols that no file
    of the project declares. A declaration fits if its words joined begin or end with the symbol, and its words that
    are no part of the symbol are technical, one at least. The index holds only names with a technical word, under
    each beginning and ending that leaves one out, and meets symbols by equality. Of a file the first name counts.
    """
    declared = facts.filter("kind = 'declaration'")
    known = declared.select("project_id", X.canonical_symbol(F.col("name")).alias("symbol")).distinct()
    open_ = asked.select("task_id", "project_id", "symbol").distinct().join(known, ["project_id", "symbol"], "left_anti")
    words = X.tokenize_identifier(F.col("name"))
    whole = F.array_join("words", "")
    names = declared.select("project_id", "file", "name", words.alias("words")).filter(F.arrays_overlap("words", X.strings(*TECHNICAL)))
    cuts = F.sequence(F.lit(4), F.length(whole) - 1)
    keys = F.array_distinct(F.concat(F.transform(cuts, lambda n: F.left(whole, n)), F.transform(cuts, lambda n: F.right(whole, n))))
    index = names.filter(F.length(whole) > 4).select("project_id", "file", "name", "words", F.explode(keys).alias("symbol"))
    rest = F.filter("words", lambda w: ~F.contains(F.col("symbol"), w))
    fits = (F.size(rest) > 0) & F.forall(rest, lambda w: w.isin(TECHNICAL))
    return index.filter(fits).groupBy("project_id", "symbol", "file").agg(F.min("name").alias("declaration")).join(open_, ["project_id", "symbol"]).select("task_id", "project_id", "symbol", "file", "declaration")


def relation(edges: DataFrame) -> DataFrame:
    """(project_id, a, b, relation): route_local or import_graph, of files that one edge joins, in both orders.

    A direct edge from a to b goes before one from b to a, and of one direction a plain import before a local one.
    """
    ahead = edges.filter("kind <> 'imported-by'").select("project_id", "src", "dst", F.when(F.col("kind") == "route-local", "route_local").otherwise("import_graph").alias("relation"))
    both = ahead.select("project_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("way"), "relation").unionByName(
        ahead.select("project_id", F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(1).alias("way"), "relation")
    )
    return both.groupBy("project_id", "a", "b").agg(F.min(F.struct("way", "relation"))["relation"].alias("relation"))


def evidence_links(asked: DataFrame, files: DataFrame, facts: DataFrame, graph: DataFrame, per_owner: int = 8) -> DataFrame:
    """(task_id, project_id, symbol, pos, file, role, evidence, relation, related): what speaks for files of a task.

    ``asked``: the columns of ``query_symbols``; ``files``: (project_id, path, role); ``facts``: (project_id, file, kind,
    name) of kinds declaration, state, property and reference; ``graph``: the columns of ``edges``. Owners declare a
    symbol, or have it as a field in a contract; each has its first ``per_owner`` consumers, which refer to it, with
    how they are joined. Of a symbol's consumers no more than ``per_owner`` + 1 are kept before they meet its owners,
    so no symbol's pairs grow with the square of its files. Symbols without a declaration go by ``suffix_owners``.
    """
    # written, so that joins go by its size and not by that of the tasks it is made of, which is taken to fit a broadcast
    asked = cut(asked)
    named = cut(facts.select("project_id", "file", "kind", X.canonical_symbol(F.col("name")).alias("symbol")).filter("symbol <> ''").distinct())
    wanted = named.join(asked.select("project_id", "symbol").distinct(), ["project_id", "symbol"], "left_semi")
    roles = files.select("project_id", F.col("path").alias("file"), F.col("role").alias("file_role"))
    folders = F.split(P.directory(F.lower("file")), "/")
    contract = F.col("file_role").isin(CONTRACT_ROLES) | F.arrays_overlap(folders, X.strings(*CONTRACT_FOLDERS))
    for end in CONTRACT_ENDS:
        contract = contract | F.endswith(F.lower("file"), F.lit(end))
    has = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    kinds = wanted.groupBy("project_id", "symbol", "file").agg(has("declaration", "state").alias("declares"), has("state").alias("is_state"), has("property").alias("is_field"), has("reference").alias("refers"))
    kinds = kinds.join(roles, ["project_id", "file"])
    owner = F.col("declares") | (F.col("is_field") & F.coalesce(contract, F.lit(False)))
    is_contract = F.col("is_field") | F.coalesce(F.col("file_role") == "types", F.lit(False))
    own_role = F.when(F.col("is_state"), "state-owner").when(is_contract, "contract").otherwise("producer")
    owners = kinds.filter(owner).select("project_id", "symbol", F.col("file").alias("owner"), own_role.alias("role"), F.when(F.col("is_state"), "state_graph").otherwise("symbol_exact").alias("evidence"))
    order = Window.partitionBy("project_id", "symbol").orderBy("file")
    few = kinds.filter("refers").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_owner + 1).select("project_id", "symbol", F.col("file").alias("consumer"))
    met = owners.select("project_id", "symbol", "owner").join(few, ["project_id", "symbol"]).filter("owner <> consumer")
    nth = F.row_number().over(Window.partitionBy("project_id", "symbol", "owner").orderBy("consumer"))
    met = met.withColumn("rank", nth).filter(F.col("rank") <= per_owner).join(
        relation(graph).withColumnsRenamed({"a": "owner", "b": "consumer"}), ["project_id", "owner", "consumer"], "left"
    )
    joined = F.col("relation").isNotNull()
    consumers = met.select(
        "project_id", "symbol", F.col("consumer").alias("file"), F.when(joined, "consumer").otherwise("reference").alias("role"),
        F.when(joined, "reference_graph").otherwise("content_supported").alias("evidence"), F.coalesce("relation", F.lit("identifier_reference")).alias("relation"), F.col("owner").alias("related"),
    )
    of_symbol = owners.select("project_id", "symbol", F.col("owner").alias("file"), "role", "evidence", F.lit("same_file").alias("relation"), F.lit(None).cast("string").alias("related")).unionByName(consumers)
    links = asked.select("task_id", "project_id", "symbol", "pos").join(of_symbol, ["project_id", "symbol"])
    near = suffix_owners(asked, facts).join(roles, ["project_id", "file"]).join(asked.select("task_id", "symbol", "pos"), ["task_id", "symbol"])
    near = near.select(
        "task_id", "project_id", F.col("declaration").alias("symbol"), "pos", "file", F.when(F.col("file_role") == "api-route", "route").otherwise("producer").alias("role"),
        F.lit("route_graph").alias("evidence"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("related"),
    )
    return links.select(near.columns).unionByName(near)


def best_by_file(links: DataFrame, symbols: int = 12, chain: int = 16) -> DataFrame:
    """(task_id, project_id, file, ownership, roles, symbols, links): the best evidence of each file of a task.

    ``roles`` in order of name, at most ``symbols`` symbols in order of the task, and how many links of at most
    ``chain`` are kept. A file's links for a task are bounded by the task's symbols, their owners' consumers included.
    """
    rank = F.coalesce(F.array_position(X.strings(*EVIDENCE), F.col("evidence")), F.lit(len(EVIDENCE)))
    grouped = links.withColumn("rank", rank).groupBy("task_id", "project_id", "file", "symbol").agg(
        F.min("pos").alias("pos"), F.min("rank").alias("rank"), F.collect_set("role").alias("roles"), F.count("*").alias("n")
    )
    place = F.row_number().over(Window.partitionBy("task_id", "project_id", "file").orderBy("pos", "symbol"))
    best = grouped.withColumn("place", place).groupBy("task_id", "project_id", "file").agg(
        F.min("rank").alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))).alias("roles"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= symbols, F.struct("place", "symbol")))).alias("s"), F.least(F.sum("n"), F.lit(chain)).alias("links"),
    )
    return best.select("task_id", "project_id", "file", F.element_at(X.strings(*EVIDENCE), F.col("rank").cast("int")).alias("ownership"), "roles", F.transform("s", lambda x: x["symbol"]).alias("symbols"), "links")


def chains(links: DataFrame, most: int = 24) -> DataFrame:
    """(task_id, rank, symbol, owner, consumer, relation): the first ``most`` chains of each task, by place of the symbol.

    A chain is an owner and a consumer that an edge joins.
    """
    found = links.filter("role = 'consumer'").select("task_id", "pos", "symbol", F.col("related").alias("owner"), F.col("file").alias("consumer"), "relation")
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy("pos", "symbol", "owner", "consumer"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).select("task_id", "rank", "symbol", "owner", "consumer", "relation")
