"""Schemas that drift between files: what changed, and one table over all files.

Each file's schema is a tree of fields, to any depth, with types. Between
consecutive files the cheapest edit script is sought: fields that keep their name
are matched to each other, and the fields that go are assigned to those that come
(a constrained edit distance of unordered trees; one assignment per pair of
matched parents). Renaming costs less the more of the content agrees for the same
rows, so the content of the paths that go or come is compared first, by
aggregation on (scope, file, row key, content).

The rows are parsed in two passes: one counts the distinct schemas of each file,
the other reads only the paths that go or come. Scripts are small (fields, not
rows). For the one table the renames form a graph of names; each field of a file
goes to the column that is nearest to its name in its project's graph, or else in
that of all projects, and that compiles into one projection per file.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.net_names import normal_name
from ..session import cut_lineage, spread_out
from ..tables import join_few, settle
from ..vocabulary import ASSIGNMENT_COLUMNS

DELETE = INSERT = 1.0
RETYPE, MOVE = 0.25, 0.75
SAME_CONTENT = 0.6  # share of common rows that must agree before a rename can be cheaper than delete and insert
MOST_NAMES = 100_000  # distinct renames of all projects that the driver takes

# The one table: its columns and their types.
TARGETS = {c: "double" if c == "final_voltage_v" else "string" for c in ASSIGNMENT_COLUMNS} | {
    "reviewed_by": "string", "waived": "boolean", "tags": "string", "cell_count": "int", "evidence": "string",
}


# ---------------------------------------------------------------- trees


@dataclass
class Node:
    """A field of a schema: its type and the fields within it."""

    kind: str = "object"
    children: dict[str, Node] = field(default_factory=dict)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())


def tree_of(paths: list[tuple[str, str]]) -> Node:
    """The tree of (path, type) entries; the parts of a path are joined by newlines."""
    root = Node()
    for path, kind in sorted(paths):
        node, *parts = root, *path.split("\n")
        for part in parts[:-1]:
            node = node.children.setdefault(part, Node())
        node.children.setdefault(parts[-1], Node(kind)).kind = kind
    return root


def cheapest_assignment(costs: list[list[float]]) -> list[int]:
    """For each row its column in the assignment of least total cost (rows <= columns)."""
    n, m = len(costs), len(costs[0]) if costs else 0
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0], i0, delta, j1 = True, match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = costs[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


Edit = tuple[str, str, str]


def edit_script(old: Node, new: Node, alike: dict[tuple[str, str], float], at: str = "", to: str = "") -> tuple[float, list[Edit]]:
    """Cost and edits (kind, old path, new path) of the cheapest script from `old` to `new`.

    `alike` gives the share of common rows whose content agrees, by (old path,
    new path). A subtree that goes at one place and comes at another under its
    own name, or with the same content, is one move.
    """
    here = lambda base, name: f"{base}\n{name}" if base else name
    cost, edits = 0.0, []
    both = [n for n in old.children if n in new.children]
    gone = sorted(n for n in old.children if n not in new.children)
    come = sorted(n for n in new.children if n not in old.children)
    pairs = [(n, n) for n in both]
    if gone and come:

        def rename_cost(a: str, b: str) -> float:
            x, y = old.children[a], new.children[b]
            share = likeness(x, y, alike, here(at, a), here(to, b))
            if share < SAME_CONTENT:
                return 1e6
            inner = edit_script(x, y, alike, here(at, a), here(to, b))[0] if x.children and y.children else 0.0
            return min(DELETE + INSERT - 1e-6, 2 * (1 - share) + inner + RETYPE * (x.kind != y.kind))

        free = [[DELETE * old.children[a].size() if i == j else 1e6 for j in range(len(gone))] for i, a in enumerate(gone)]
        matrix = [[rename_cost(a, b) - 0.5 * INSERT * new.children[b].size() for b in come] + free[i] for i, a in enumerate(gone)]
        for i, j in enumerate(cheapest_assignment(matrix)):
            if j < len(come) and rename_cost(gone[i], come[j]) < DELETE + INSERT:
                pairs.append((gone[i], come[j]))
    for a, b in pairs:
        x, y = old.children[a], new.children[b]
        if a != b:
            cost += 2 * (1 - likeness(x, y, alike, here(at, a), here(to, b)))
            edits.append(("renamed", here(at, a), here(to, b)))
        if x.kind != y.kind and "null" not in (x.kind, y.kind):
            cost += RETYPE
            edits.append(("retyped", here(at, a), here(to, b)))
        elif x.children or y.children:
            inner, more = edit_script(x, y, alike, here(at, a), here(to, b))
            cost, edits = cost + inner, edits + more
    for name in gone:
        if name not in {a for a, _ in pairs}:
            cost += DELETE * old.children[name].size()
            edits.append(("removed", here(at, name), ""))
    for name in come:
        if name not in {b for _, b in pairs}:
            cost += INSERT * new.children[name].size()
            edits.append(("added", "", here(to, name)))
    if not at and not to:
        cost, edits = _with_moves(cost, edits, alike)
    return cost, edits


def likeness(old: Node, new: Node, alike: dict[tuple[str, str], float], at: str, to: str) -> float:
    """Share of agreeing content of two subtrees: as a whole, or of their fields under the best pairing of names."""
    whole = alike.get((at, to), 0.0)
    if not old.children or not new.children:
        return whole
    below = lambda base, name: f"{base}\n{name}"
    best = [max(likeness(x, y, alike, below(at, a), below(to, b)) for b, y in new.children.items()) for a, x in old.children.items()]
    return max(whole, sum(best) / max(len(best), len(new.children)))


def _with_moves(cost: float, edits: list[Edit], alike: dict[tuple[str, str], float]) -> tuple[float, list[Edit]]:
    leaf = lambda path: path.rpartition("\n")[2]
    parent = lambda path: path.rpartition("\n")[0]
    come = {e[2]: e for e in edits if e[0] == "added"}
    for edit in [e for e in edits if e[0] == "removed"]:
        elsewhere = [p for p in sorted(come) if parent(p) != parent(edit[1])]
        to = next((p for p in elsewhere if leaf(p) == leaf(edit[1])), None) or next((p for p in elsewhere if alike.get((edit[1], p), 0.0) >= SAME_CONTENT), None)
        if to is not None:
            edits.remove(edit)
            edits.remove(come.pop(to))
            edits.append(("moved", edit[1], to))
            cost += MOVE - DELETE - INSERT
    return cost, edits


# ---------------------------------------------------------------- profiles and content


def _part(name: str) -> str:
    """A key as part of a path, whose parts are joined by line breaks."""
    return name.replace("\\", "\\\\").replace("\n", "\\n")


def _key(part: str) -> str:
    return part.replace("\\\\", "\0").replace("\\n", "\n").replace("\0", "\\")


def variant_path(path: str) -> str | None:
    """A path as the JVM reads it; null for a key that holds both kinds of quotation marks."""
    out = "$"
    for part in path.split("\n"):
        key = _key(part)
        mark = next((m for m in ("'", '"') if m not in key), None)
        if mark is None:
            return None
        out += f"[{mark}{key}{mark}]"
    return out


def shown_path(path: str) -> str:
    """A path as in reports: a top-level key as it is, nested ones joined by points."""
    return ".".join(map(_key, path.split("\n")))


KIND_OF = {"N": "number", "STRING": "text", "BOOLEAN": "boolean", "VOID": "null"}
NUMBERS = r"(`(?:[^`]|``)*`)|\b(?:BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT)(?=[,>]|$)"


def numberless(schema: Column) -> Column:
    """A variant's schema with one sign N for all number types (and an N behind quoted names)."""
    return F.regexp_replace(schema, NUMBERS, "$1N")


def schema_paths(text: str) -> list[tuple[str, str]]:
    """(path, kind) of every field in a schema as `numberless` writes it."""
    out: list[tuple[str, str]] = []
    at = 0

    def name() -> str:
        nonlocal at
        if text[at] == "`":
            end = at + 1
            while text[end] != "`" or text[end + 1 : end + 2] == "`":
                end += 2 if text[end] == "`" else 1
            got, at = text[at + 1 : end].replace("``", "`"), end + 2  # the mark and the N behind it
        else:
            end = text.index(":", at)
            got, at = text[at:end], end
        return got

    def value(path: str) -> str:
        nonlocal at
        if text.startswith("OBJECT<", at):
            at += len("OBJECT<")
            while text[at] != ">":
                inner = f"{path}\n{_part(name())}" if path else _part(name())
                at += len(": ")
                place = len(out)
                kind = value(inner)
                out.insert(place, (inner, kind))
                if text.startswith(", ", at):
                    at += len(", ")
            at += 1
            return "object"
        if text.startswith("ARRAY<", at):
            depth, at = 1, at + len("ARRAY<")
            while depth:
                if text[at] == "`":
                    name()
                    continue
                depth += {"<": 1, ">": -1}.get(text[at], 0)
                at += 1
            return "list"
        end = at
        while end < len(text) and text[end] not in ",>":
            end += 1
        got, at = text[at:end], end
        return KIND_OF.get(got, "text")

    return out if value("") == "object" else []


@F.udf(ArrayType(StructType([StructField("path", StringType()), StructField("place", StringType())])), useArrow=True)
def _located(paths):
    """Paths with where the JVM finds them; those it can't read are left out."""
    found = [{"path": p, "place": variant_path(p)} for p in paths]
    return [f for f in found if f["place"]]


def usable_rows(rows: DataFrame) -> DataFrame:
    """(project_id, file_no, payload) of the rows that can count, dealt out over the cores."""
    used = rows.filter("project_id is not null and file_no is not null and payload is not null").select("project_id", "file_no", "payload")
    return spread_out(used)


def file_profile(rows: DataFrame) -> DataFrame:
    """(project_id, file_no, path, kind) of every field of every file: the most frequent non-null type, then by name.

    One pass over the rows; what leaves a task is each distinct schema of a file
    with its number of rows. Fields within a field that is mostly no object don't
    come out.
    """
    schema = numberless(F.schema_of_variant(F.try_parse_json("payload")))
    schemas = usable_rows(rows).groupBy("project_id", "file_no", schema.alias("schema")).agg(F.count("*").alias("n"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for project, no, schema, n in batch[["project_id", "file_no", "schema", "n"]].itertuples(index=False):
                for path, kind in schema_paths(schema) if isinstance(schema, str) else ():
                    found[project, no, path, kind] += n
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["project_id", "file_no", "path", "kind", "n"])

    counts = schemas.mapInPandas(counted, "project_id string, file_no int, path string, kind string, n bigint")
    counts = counts.groupBy("project_id", "file_no", "path", "kind").agg(F.sum("n").alias("n"))
    rank = F.struct(F.when(F.col("kind") == "null", 0).otherwise(1).alias("a"), F.col("n").alias("b"), F.col("kind").alias("c"))
    return cut_lineage(counts.groupBy("project_id", "file_no", "path").agg(F.max(rank)["c"].alias("kind")))


def file_trees(profile: DataFrame) -> DataFrame:
    """(project_id, file_no, paths): a file's fields as an array of (path, kind)."""
    return profile.groupBy("project_id", "file_no").agg(F.sort_array(F.collect_list(F.struct("path", "kind"))).alias("paths"))


def consecutive_files(rows: DataFrame) -> DataFrame:
    """(project_id, from_file, to_file) of each file and the next one present."""
    files = rows.filter("file_no is not null and project_id is not null").select("project_id", "file_no").distinct()
    after = F.lead("file_no").over(Window.partitionBy("project_id").orderBy("file_no"))
    return files.select("project_id", F.col("file_no").alias("from_file"), after.alias("to_file")).filter("to_file is not null")


def _words(text: Column) -> Column:
    """The words of a name or label, lower case, with `_` between and around them."""
    parted = F.lower(F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1_$2"))
    return F.concat(F.lit("_"), F.regexp_replace(F.regexp_replace(parted, r"[^\p{L}]+", "_"), "^_|_$", ""), F.lit("_"))


def content_keys(text: Column) -> Column:
    """Under what a value's content is equal to another's as number, text, list or otherwise.

    An array of (content, label): the value itself, without a label; and for words
    around a single number that number, with the words, as `3` for `Zone 3`.
    """
    bare = F.trim(text)
    number = bare.try_cast("double")
    listed = F.regexp_replace(F.regexp_replace(bare, r'^\[|\]$|"', ""), r"\s*[;,|]\s*", ";")
    parsed = F.when(bare.rlike(r"(?s)^[\[{].*[\]}]$"), F.to_json(F.try_parse_json(bare)))
    word = F.lower(bare)
    own = (
        F.when(number.isNotNull(), number.cast("string"))
        .when(word.isin("true", "yes"), "true")
        .when(word.isin("false", "no"), "false")
        .when(bare.startswith("{") & parsed.isNotNull(), parsed)
        .otherwise(listed)
    )
    within = F.when(number.isNull(), F.regexp_extract(bare, r"^[^\d{\[]*(\d+(?:\.\d+)?)\D*$", 1).try_cast("double").cast("string"))
    key = lambda content, label: F.struct(content.alias("content"), label.alias("label"))
    return F.array_compact(F.array(key(own, F.lit("")), F.when(within.isNotNull(), key(within, _words(bare)))))


def content_agreement(rows: DataFrame, work: DataFrame) -> DataFrame:
    """(project_id, from_file, old_path, new_path, share) for paths that go and come together.

    `work` has project_id, from_file, to_file, gone and come (arrays of paths).
    The share of the nets with a value under both paths whose values agree; rows
    repeated or equal in content count once. A label around a number is no content
    if it repeats the name of either field. Aggregated first on (net, content),
    so a net that most rows share spreads over its contents, then on the net.
    """
    both = work.filter("size(gone) > 0 and size(come) > 0")
    sides = [(F.col("from_file"), True, "gone"), (F.col("to_file"), False, "come")]
    asked = [both.select("project_id", file.alias("file_no"), F.struct("from_file", F.lit(old).alias("old"), _located(F.col(paths)).alias("paths")).alias("ask")) for file, old, paths in sides]
    per_file = cut_lineage(asked[0].unionByName(asked[1]).groupBy("project_id", "file_no").agg(F.collect_list("ask").alias("asks")))
    met = join_few(usable_rows(rows), per_file, ["project_id", "file_no"], "inner", spread=["payload"])
    values = met.select("project_id", F.try_parse_json("payload").alias("v"), F.explode("asks").alias("ask")).select("project_id", "v", "ask.from_file", "ask.old", F.explode("ask.paths").alias("at"))
    read = settle(values, text=F.expr("try_variant_get(v, at.place, 'string')"), net=normal_name(F.expr("try_variant_get(v, '$.net_name', 'string')"))).filter("text is not null and net is not null")
    keyed = read.select("project_id", "from_file", "net", "old", F.col("at.path").alias("path"), F.explode(content_keys(F.col("text"))).alias("k"))
    name = lambda old: F.collect_set(F.when(F.col("old") == old, F.struct("path", "k.label")))
    contents = keyed.groupBy("project_id", "from_file", "net", F.col("k.content").alias("content")).agg(name(True).alias("gone"), name(False).alias("come"))
    token = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    none = F.lit("")
    fits = lambda label, g, c: (label == "") | F.contains(F.concat(_words(g["path"]), _words(c["path"])), label)
    agree = F.flatten(F.transform("gone", lambda g: F.transform(F.filter("come", lambda c: fits(g["label"], g, c) & fits(c["label"], g, c)), lambda c: token("same", g["path"], c["path"]))))
    tokens = F.concat(F.transform("gone", lambda g: token("gone", g["path"], none)), F.transform("come", lambda c: token("come", c["path"], none)), agree)
    nets = contents.select("project_id", "from_file", "net", F.explode(tokens).alias("t")).groupBy("project_id", "from_file", "net").agg(F.collect_set("t").alias("ts"))
    of = lambda kind: F.filter("ts", lambda t: t["kind"] == kind)
    pairs = F.flatten(F.transform(of("gone"), lambda g: F.transform(of("come"), lambda c: token("same", g["a"], c["a"]))))
    met = nets.select("project_id", "from_file", "ts", F.explode(pairs).alias("p")).select("project_id", "from_file", "p.a", "p.b", F.array_contains("ts", F.col("p")).cast("int").alias("same"))
    shares = met.groupBy("project_id", "from_file", F.col("a").alias("old_path"), F.col("b").alias("new_path")).agg((F.sum("same") / F.count("same")).alias("share"))
    return shares.filter(F.col("share") > 0)


CHANGES = (
    "project_id string, from_file int, to_file int, change_kind string, old_field string, new_field string, nested boolean, cost double, old_path string, new_path string"
)


def schema_changes(rows: DataFrame) -> DataFrame:
    """All edits between consecutive files of each project.

    (project_id, from_file, to_file, change_kind, old_field, new_field, nested,
    cost, old_path, new_path): `added`, `removed`, `renamed`, `retyped` and `moved`
    of fields, nested ones with their path (parts joined by `.`), and the script's
    total cost. Null project_ids are left out, as are rows without file_no. Fields
    with only null values have no type and are never retyped. Repeated rows count
    once. Rows that are no JSON object, or hold a key twice, have no fields.
    """
    profile = file_profile(rows)
    pairs = consecutive_files(rows)
    trees = file_trees(profile)
    work = (
        pairs.join(trees.select("project_id", F.col("file_no").alias("from_file"), F.col("paths").alias("old")), ["project_id", "from_file"], "left")
        .join(trees.select("project_id", F.col("file_no").alias("to_file"), F.col("paths").alias("new")), ["project_id", "to_file"], "left")
        .select("project_id", "from_file", "to_file", *[F.coalesce(c, F.array().cast("array<struct<path:string,kind:string>>")).alias(c) for c in ("old", "new")])
    )
    only = lambda a, b: F.array_except(F.transform(a, lambda x: x["path"]), F.transform(b, lambda x: x["path"]))
    work = cut_lineage(work.select("*", only("old", "new").alias("gone"), only("new", "old").alias("come")))
    alike = content_agreement(rows, work).groupBy("project_id", "from_file").agg(F.collect_list(F.struct("old_path", "new_path", "share")).alias("alike"))
    changed = work.filter((F.col("old") != F.col("new"))).drop("gone", "come").join(alike, ["project_id", "from_file"], "left")

    def scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                alike = {(a["old_path"], a["new_path"]): a["share"] for a in (row.alike if row.alike is not None else ())}
                old, new = (tree_of([(p["path"], p["kind"]) for p in side]) for side in (row.old, row.new))
                cost, edits = edit_script(old, new, alike)
                found += [(row.project_id, row.from_file, row.to_file, k, shown_path(a), shown_path(b), "\n" in a or "\n" in b, cost, a, b) for k, a, b in edits]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in CHANGES.split(", ")])

    return changed.mapInPandas(scripts, CHANGES)


def top_level_changes(changes: DataFrame) -> DataFrame:
    """The changes of top-level fields alone: what moves into or out of another field is removed or added there."""
    moved = F.col("change_kind") == "moved"
    leaves = moved & ~F.contains("old_path", F.lit("\n"))
    comes = moved & ~F.contains("new_path", F.lit("\n"))
    kinds = F.when(~moved & ~F.col("nested"), F.array("change_kind")).otherwise(F.array_compact(F.array(F.when(leaves, "removed"), F.when(comes, "added"))))
    out = changes.select("*", F.explode(kinds).alias("__kind"))
    return out.select(
        "project_id", "from_file", "to_file", F.col("__kind").alias("change_kind"),
        F.when(F.col("__kind") == "added", "").otherwise(F.col("old_field")).alias("old_field"), F.when(F.col("__kind") == "removed", "").otherwise(F.col("new_field")).alias("new_field"),
    )


# ---------------------------------------------------------------- one table


def nearest_targets(edges: Mapping[tuple[str, str], float], targets: Sequence[str]) -> dict[str, tuple[str, float]]:
    """For each name the target nearest to it in the undirected graph of `edges` (with their lengths), and how far.

    A target is its own; equally near ones are settled by the name of the target.
    """
    beside: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for (a, b), length in sorted(edges.items()):
        beside[a].append((b, length))
        beside[b].append((a, length))
    found: dict[str, tuple[str, float]] = {}
    front = [(0.0, t, t) for t in sorted(targets)]
    while front:
        front.sort()
        far, target, name = front.pop(0)
        if name in found:
            continue
        found[name] = (target, far)
        front += [(far + length, target, other) for other, length in beside[name] if other not in found and other not in targets]
    return found


def common_names(edges: Mapping[tuple[str, str], float], used: Mapping[str, int], taken: Mapping[str, object]) -> dict[str, str]:
    """One spelling for linked names that no target takes: of each connected group the most used, then the first."""
    groups: dict[str, set[str]] = {}
    for a, b in edges:
        joined = groups.get(a, {a}) | groups.get(b, {b})
        groups |= dict.fromkeys(joined, joined)
    best = lambda group: min(group, key=lambda name: (-used.get(name, 0), name))
    return {name: best(group) for name, group in groups.items() if not group & taken.keys()}


def compile_projections(profile: DataFrame, changes: DataFrame, targets: Mapping[str, str] = TARGETS, names: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(project_id, file_no, places, spellings): where each target's field lies in that file's objects, and new names of others.

    Renames and moves link the names that a project has used, in both directions
    of time; a file's field goes to the target nearest to it in that graph, or,
    where the project's own files never link it to one, in the graph of all
    projects (there links that more projects show are shorter). `names` may add
    names known from elsewhere. Of several fields for one column the nearer counts,
    then the first by name. Top-level fields without a target get the most used of
    the names they are linked with. Per project the names are gathered, not the files.
    """
    given = {(t, name): 1.0 for t, others in (names or {}).items() for name in others}
    linked = cut_lineage(changes.filter(F.col("change_kind").isin("renamed", "moved")).select("project_id", "old_path", "new_path").distinct())
    shown = linked.groupBy("old_path", "new_path").agg(F.count("*").alias("n")).limit(MOST_NAMES + 1).collect()
    if len(shown) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} distinct renames")
    lengths = given | {(r["old_path"], r["new_path"]): 1 + 1 / r["n"] for r in shown}
    everywhere = nearest_targets(lengths, list(targets))
    loose = {p for r in shown for p in (r["old_path"], r["new_path"])} - everywhere.keys()
    ends = linked.select(F.explode(F.array("old_path", "new_path")).alias("path")).distinct()
    used = {r["path"]: r["count"] for r in profile.join(ends, "path").groupBy("path").count().collect()} if loose else {}
    spelling = common_names({e: f for e, f in lengths.items() if not any("\n" in p for p in e)}, used, everywhere)
    per_project = profile.groupBy("project_id").agg(F.collect_set("path").alias("paths"))
    edges = linked.groupBy("project_id").agg(F.collect_set(F.struct("old_path", "new_path")).alias("edges"))

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = nearest_targets(given | {(e["old_path"], e["new_path"]): 1.0 for e in (row.edges if row.edges is not None else ())}, list(targets))
                for path in row.paths:
                    target, far = own.get(path) or everywhere.get(path) or (None, 0.0)
                    place = variant_path(path)
                    if target is None:
                        out.append((row.project_id, path, None, 0.0, None, spelling.get(path)))
                    elif place:
                        out.append((row.project_id, path, target, far if path in own else 1000 + far, place, None))
            yield pd.DataFrame(out, columns=["project_id", "path", "target", "far", "place", "spelling"], dtype=object).astype({"far": float})

    goals = per_project.join(edges, "project_id", "left").mapInPandas(assigned, "project_id string, path string, target string, far double, place string, spelling string")
    goals = cut_lineage(profile.select("project_id", "file_no", "path").join(goals, ["project_id", "path"]))
    best = goals.filter("target is not null").groupBy("project_id", "file_no", "target").agg(F.min(F.struct("far", "path", "place"))["place"].alias("place"))
    places = best.groupBy("project_id", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("target", "place"))).alias("places"))
    free = goals.select("project_id", "file_no", F.col("path").alias("spelling"))
    other = goals.filter("spelling <> path").groupBy("project_id", "file_no", "spelling").agg(F.min("path").alias("path")).join(free, ["project_id", "file_no", "spelling"], "left_anti")
    spellings = other.groupBy("project_id", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("path", "spelling"))).alias("spellings"))
    return places.join(spellings, ["project_id", "file_no"], "full_outer")


def consistent_table(rows: DataFrame, changes: DataFrame, *, targets: Mapping[str, str] = TARGETS, names: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Every distinct object of every file in one schema (`targets`), by its file's projection.

    Values that don't fit the column's type become null and are named in
    `unfit`; top-level fields without a target are kept as JSON in `extra`, under
    one spelling wherever renames link several. Payloads that are no JSON object,
    or hold a key twice, give a row of nulls.
    """
    projections = cut_lineage(compile_projections(file_profile(rows), changes, targets, names))
    objects = rows.filter("project_id is not null and file_no is not null").select("project_id", "file_no", "payload").dropDuplicates()
    joined = join_few(objects, projections, ["project_id", "file_no"], spread=["payload"])
    places = [F.try_element_at("places", F.lit(t)).alias(f"__at{k}") for k, t in enumerate(targets)]
    keys = F.transform(F.map_values(F.coalesce("places", F.create_map().cast("map<string,string>"))), lambda p: F.regexp_extract(p, r"""^\$\[(?:'([^']*)'|"([^"]*)")\]$""", 1))
    joined = joined.select("project_id", "file_no", "payload", "spellings", F.try_parse_json("payload").alias("v"), keys.alias("__used"), *places)
    joined = settle(joined, **{f"__raw{k}": F.expr(f"try_variant_get(v, __at{k}, 'string')") for k in range(len(targets))})
    columns, unfit = [], []
    for k, (target, kind) in enumerate(targets.items()):
        raw = F.col(f"__raw{k}")
        if kind == "string":
            columns.append(raw.alias(target))
            continue
        if kind == "boolean":
            value = F.when(F.lower(F.trim(raw)).isin("true", "yes", "1"), True).when(F.lower(F.trim(raw)).isin("false", "no", "0"), False)
        else:
            value = F.trim(raw).try_cast(kind)
        columns.append(value.alias(target))
        unfit.append(F.when((F.trim(raw) != "") & value.isNull(), F.lit(target)))
    entries = F.from_json(F.when(F.col("v").isNotNull(), F.col("payload")), "map<string,string>")
    extra = F.map_filter(entries, lambda k, _: ~F.array_contains("__used", k))
    extra = F.transform_keys(extra, lambda k, _: F.coalesce(F.try_element_at("spellings", k), k))
    return joined.select("project_id", "file_no", *columns, F.array_compact(F.array(*unfit)).alias("unfit"), F.when(F.size(extra) > 0, F.to_json(extra)).alias("extra"))
