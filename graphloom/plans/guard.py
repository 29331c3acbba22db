"""Read-only SQL: a statement runs only if every node of its parsed plan is on a list of what may run.

The text is parsed, not run. The walk goes over the plans and expressions of the parsed statement, subqueries within
expressions included. Functions must be built-in ones that don't run code or reach outside; relations must be names that the
statement defines, views of the session, or tables that the catalog has, so nothing is read by path.

A walk asks the JVM for each node's children, class and so on, some hundred calls. So a plan is first taken as one JSON text; the
walk is for plans whose text may have left something out, or has a class that isn't known here.

Tables of statements (codes()) are parsed by the tasks that read them, by the same parser, and their plans' texts are looked through there. The
driver's catalog is asked once for each name that it lists, and the driver walks the plans that their text leaves open.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import batched, product

from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphError
from ..lineage import Checkpoint, shared_dir

ALLOWED = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit LimitAll Offset Distinct SubqueryAlias UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedInlineTable LocalRelation "
    "OneRowRelation$ OneRowRelation Join LateralJoin Union Intersect Except UnresolvedWith Window WindowExpression WithWindowDefinition UnresolvedHaving Generate Expand Pivot Unpivot UnresolvedPivot UnresolvedTableValuedFunction "
    "UnresolvedTVFAliases Tail Sample ParameterizedQuery NameParameterizedQuery PosParameterizedQuery UnresolvedHint ResolvedHint UnionLoop UnionLoopRef Range CTERelationDef CTERelationRef WithCTE View GroupingSets UnresolvedOrdinal RecursiveCTE AsOfJoin".split()
)
#: Built-in functions that run code of the caller's choice or reach outside the query, and what stands for names made at run time.
DENIED_FUNCTIONS = frozenset("reflect java_method try_reflect read_files from_avro to_avro input_file_name input_file_block_start input_file_block_length python_worker_logs".split())
DENIED_EXPRESSIONS = ("ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier", "UnresolvedIdentifier")


#: Where classes are expressions only; those of the analyzer's package by name.
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
UNRESOLVED = frozenset(f"org.apache.spark.sql.catalyst.analysis.{x}" for x in ("UnresolvedAlias", "UnresolvedAttribute", "UnresolvedFunction", "UnresolvedStar", "UnresolvedExtractValue"))
LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: Fields whose null in a plan's JSON hides no plan and no expression; any other null may.
HIDE_NOTHING = frozenset((("UnresolvedRelation", "options"), ("Literal", "value")))
#: Databases that the catalog doesn't list, or that aren't the catalog's.
OTHER_NAMES = frozenset("global_temp session system builtin spark_catalog".split())


def each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.length()))


def refused(message: str) -> GraphError:
    return GraphError("READ_ONLY_VIOLATION", message)


def nodes(plan) -> Iterator[tuple[str, object]]:
    """('plan', node) and ('expression', node) for all that a parsed plan holds, wherever it is held."""
    yield "plan", plan
    for child in each(plan.children()):
        yield from nodes(child)
    for inner in each(plan.innerChildren()):
        if "LogicalPlan" in ancestry(inner):
            yield from nodes(inner)
    if plan.getClass().getSimpleName() == "UnresolvedWith":
        for relation in each(plan.cteRelations()):
            yield from nodes(relation._2())
    for e in each(plan.expressions()):
        yield from expressions(e)


def expressions(e) -> Iterator[tuple[str, object]]:
    yield "expression", e
    if "PlanExpression" in ancestry(e):
        yield from nodes(e.plan())
    for child in each(e.children()):
        yield from expressions(child)


def ancestry(x) -> set[str]:
    """Simple names of an object's classes."""
    found, kind = set(), x.getClass()
    while kind is not None:
        found.add(kind.getSimpleName())
        kind = kind.getSuperclass()
    return found


def described(plan) -> list[dict] | None:
    """All nodes that a parsed plan holds, as JSON, from one call; None if the text may lack some, or has a class that isn't known here."""
    try:
        return described_text(plan.toJSON())
    except (Py4JJavaError, PySparkException):  # a class whose fields Spark can't name
        return None


def described_text(text: str) -> list[dict] | None:
    """The same of the JSON itself."""
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return None
    found, open_ = [], [("", "", root)]
    while open_:
        owner, field, x = open_.pop()
        if isinstance(x, list):
            open_ += [(owner, field, y) for y in x]
        elif isinstance(x, dict):
            kind = x.get("class", "")
            name = kind.rpartition(".")[2]
            if kind and not (name in ALLOWED or kind.startswith(EXPRESSIONS) or kind in UNRESOLVED):
                return None
            found += [x] if kind else []
            open_ += [(name, k, y) for k, y in x.items()]
        elif x is None and (owner, field) not in HIDE_NOTHING:
            return None
    return found


def readings(text: str) -> list[list[str]] | None:
    """The names that a list of names in a plan's JSON can stand for: a comma is between two, or in one. None: too many, or cut."""
    parts = text[1:-1].split(", ")
    if len(parts) > 3 or "more fields" in text:
        return None
    out = []
    for cuts in product((True, False), repeat=len(parts) - 1):
        names = parts[:1]
        for cut, part in zip(cuts, parts[1:]):
            names = [*names, part] if cut else [*names[:-1], f"{names[-1]}, {part}"]
        out.append(names)
    return out


def check_described(found: list[dict], functions: frozenset[str], relation: Callable[[list[str], bool], None]) -> bool:
    """relation(parts, sure) raises unless there is such a table; sure: nothing else can be meant. Whether the nodes may run; False also where the names aren't certain, and the walk has to say. Raises if none of the readings may run."""
    of = lambda name: (x for x in found if x["class"].endswith(f".{name}"))
    if any(x["class"].rpartition(".")[2] in DENIED_EXPRESSIONS for x in found) or any(of("UnresolvedTableValuedFunction")):
        return False
    defined = {str(r["_1"]).lower() for w in of("UnresolvedWith") for r in w["cteRelations"]}
    certain = True
    table = lambda p, sure: None if len(p) == 1 and p[0].lower() in defined else relation(p, sure)
    for name, field, test in (("UnresolvedRelation", "multipartIdentifier", table), ("UnresolvedFunction", "nameParts", lambda p, sure: known_function(p, functions))):
        for x in of(name):
            if (meant := readings(x[field])) is None:
                certain = False
                continue
            errors = []
            for parts in meant:
                try:
                    test(parts, len(meant) == 1)
                except GraphError as e:
                    errors.append(e)
            if len(errors) == len(meant):
                raise errors[0]
            certain = certain and not errors and len(meant) == 1
    return certain


_built_in: dict[bool, frozenset[str]] = {}  # the registries of built-in functions don't change


def built_in(spark: SparkSession, tables: bool) -> frozenset[str]:
    if tables in _built_in:
        return _built_in[tables]
    analysis = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.analysis
    registry = analysis.TableFunctionRegistry.builtin() if tables else analysis.FunctionRegistry.builtin()
    _built_in[tables] = frozenset(f.funcName() for f in each(registry.listFunction())) - DENIED_FUNCTIONS
    return _built_in[tables]


def names_of(parts) -> list[str]:
    return [str(x) for x in each(parts)]


def check(spark: SparkSession, text: str, known: dict | None = None) -> None:
    """Raises READ_ONLY_VIOLATION or QUERY_PARSE_ERROR unless the statement only reads tables and views of the session.

    known: what the catalog has said, for statements that are checked together; the catalog isn't asked the same again.
    """
    known = {} if known is None else known
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(text)
    except (ParseException, Py4JJavaError) as e:
        raise GraphError("QUERY_PARSE_ERROR", str(e).splitlines()[0]) from e
    check_kind(plan.getClass().getName())
    if (nodes_ := described(plan)) is not None and check_described(nodes_, built_in(spark, False), lambda parts, _: known_relation(spark, parts, set(), known)):
        return
    found = list(nodes(plan))
    defined = {str(r._1()).lower() for kind, p in found if kind == "plan" and p.getClass().getSimpleName() == "UnresolvedWith" for r in each(p.cteRelations())}
    functions = table_functions = None
    for kind, p in found:
        name = p.getClass().getSimpleName()
        if kind == "plan" and name not in ALLOWED or name in DENIED_EXPRESSIONS:
            raise refused(f"{name} isn't allowed")
        if name == "UnresolvedRelation":
            known_relation(spark, names_of(p.multipartIdentifier()), defined, known)
        elif name == "UnresolvedTableValuedFunction":
            table_functions = table_functions or built_in(spark, True)
            known_function(names_of(p.name()), table_functions)
        elif name == "UnresolvedFunction":
            functions = functions or built_in(spark, False)
            known_function(names_of(p.nameParts()), functions)


def check_kind(kind: str) -> None:
    """Of the class of a statement's plan."""
    if kind.startswith(LOGICAL) and (name := kind.removeprefix(LOGICAL)) not in ALLOWED:
        raise refused(f"{name} isn't allowed")


def known_function(parts: list[str], known: frozenset[str]) -> None:
    if [x.lower() for x in parts[:-1]] not in ([], ["builtin"], ["system", "builtin"]) or parts[-1].lower() not in known:
        raise refused(f"{'.'.join(parts)} isn't a function that may be called")


def known_relation(spark: SparkSession, parts: list[str], defined: set[str], known: dict) -> None:
    """A name that the statement defines, a view of the session, or a table of the catalog; never a path or a data source."""
    if len(parts) == 1 and parts[0].lower() in defined:
        return
    quoted = ".".join(map(quoted_name, parts))
    if len(parts) == 2 and not has_database(spark, parts[0], known) or not asked(known, ("table", quoted), lambda: spark.catalog.tableExists(quoted)):
        raise refused(f"{quoted} isn't a table or view of this session")


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def has_database(spark: SparkSession, name: str, known: dict) -> bool:
    """False if there is no such database or catalog, so no table of it: paths come by the thousand, of few data sources."""
    other = lambda: spark.conf.get(f"spark.sql.catalog.{name}", None) is not None
    return name.lower() in OTHER_NAMES or asked(known, ("database", name), lambda: other() or spark.catalog.databaseExists(quoted_name(name)))


def asked(known: dict, key: tuple[str, str], ask) -> bool:
    if key not in known:
        try:
            known[key] = ask()
        except Exception:  # not a name that a catalog can have
            known[key] = False
    return known[key]


# ---------------------------------------------------------------- tables of statements

PARSER = "org.apache.spark.sql.execution.SparkSqlParser"
#: The parsed plan's class, and in a line of its own its JSON (nothing if Spark can't write it); null if the statement can't be parsed.
STATEMENT_PLAN = """
package graphloom;
public class StatementPlan implements org.apache.spark.sql.api.java.UDF1<Object, Object> {
  private transient org.apache.spark.sql.catalyst.parser.ParserInterface parser;
  public Object call(Object text) {
    org.apache.spark.sql.catalyst.plans.logical.LogicalPlan plan;
    if (parser == null) parser = new %s();
    try { plan = parser.parsePlan((String) text); } catch (Throwable e) { return null; }
    String kind = plan.getClass().getName() + "\\n";
    try { return kind + plan.toJSON(); } catch (Throwable e) { return kind; }
  }
}
""" % PARSER


def register_statement_plan(spark: SparkSession) -> str:
    """The session's SQL function for STATEMENT_PLAN; compiled by the compiler that Spark has for its plans, and sent to executors as a jar."""
    name, jvm = "graphloom_statement_plan", spark.sparkContext._jvm
    if spark.catalog.functionExists(name):
        return name
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(STATEMENT_PLAN)
    classes, jar = compiler.getBytecodes(), io.BytesIO()
    with zipfile.ZipFile(jar, "w") as z:
        for kind in classes.keySet():
            z.writestr(kind.replace(".", "/") + ".class", bytes(classes.get(kind)))
    path = f"{shared_dir(spark, 'guard')}/statement-plan-{uuid.uuid4().hex}.jar"
    file = jvm.org.apache.hadoop.fs.Path(path)
    out = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(file, False)
    out.write(bytearray(jar.getvalue()))
    out.close()
    spark.sql(f"ADD JAR '{path}'")
    new_array = spark.sparkContext._gateway.new_array
    found = spark._jsparkSession.sharedState().jarClassLoader().loadClass("graphloom.StatementPlan")
    function = found.getDeclaredConstructor(new_array(jvm.java.lang.Class, 0)).newInstance(new_array(jvm.java.lang.Object, 0))
    spark._jsparkSession.udf().register(name, function, spark._jsparkSession.parseDataType('"string"'))
    return name


def listed(spark: SparkSession) -> tuple[frozenset[str], frozenset[str]] | None:
    """Lower-case names of the tables and views that one-part names can mean, and of what can come before a table's name; None if the catalog isn't Spark's own."""
    catalogs = [k.split(".")[3] for k in spark.conf.getAll if k.startswith("spark.sql.catalog.")]
    if spark.catalog.currentCatalog() != "spark_catalog" or "spark_catalog" in catalogs:
        return None
    tables = (r.tableName.lower() for r in spark.sql("SHOW TABLES").select("tableName").toLocalIterator())
    databases = (r[0].lower() for r in spark.sql("SHOW DATABASES").toLocalIterator())
    return frozenset(tables), OTHER_NAMES | {x.lower() for x in catalogs} | frozenset(databases)


def judged(plan: str | None, functions: frozenset[str], names: tuple[frozenset[str], frozenset[str]] | None) -> tuple[str | None, list[str]]:
    """A statement's code, as far as its plan's text tells, and the names that it is right for if the catalog has them; no code: the plan has to be walked."""
    if plan is None:
        return "QUERY_PARSE_ERROR", []
    kind, _, text = plan.partition("\n")
    asked_for, open_ = [], []

    def relation(parts: list[str], sure: bool) -> None:
        if names and (len(parts) == 1 and parts[0].lower() not in names[0] or len(parts) == 2 and parts[0].lower() not in names[1]):
            raise refused("not in the catalog")
        (asked_for if sure else open_).append(".".join(map(quoted_name, parts)))

    try:
        check_kind(kind)
        certain = (found := described_text(text)) is not None and check_described(found, functions, relation) and not open_
    except GraphError as e:
        return e.code, []
    return ("", asked_for) if certain else (None, [])


def codes(statements: DataFrame, checkpoint: Checkpoint) -> DataFrame:
    """statements (statement, and other columns) with code: that of check()'s error, or '' for what may run."""
    spark, known = statements.sparkSession, {}
    keys = [c for c in statements.columns if c != "statement"]
    kind = "struct<code string, names array<string>>"
    if spark._jsparkSession.sessionState().sqlParser().getClass().getName() == PARSER:
        functions, names = built_in(spark, False), listed(spark)
        plan = F.call_function(register_statement_plan(spark), F.col("statement"))
        judge = F.udf(lambda text: judged(text, functions, names), kind)(plan)
    else:  # a parser of the session's own, which tasks don't have
        judge = F.lit(None).cast(kind)
    text = F.when(F.col("judged.code").isNull(), F.col("statement"))
    found = checkpoint(statements.withColumn("judged", judge).select(*keys, F.col("judged.code").alias("code"), F.col("judged.names").alias("names"), text.alias("statement")))
    # what is asked for is in a listing, and what isn't there is only kept in case of another catalog: as many names as tables, not as statements
    wanted = found.where("size(names) > 0").select(F.explode("names").alias("name")).distinct()
    there = [r.name for r in wanted.toLocalIterator() if asked(known, ("table", r.name), lambda: spark.catalog.tableExists(r.name))]
    missing = F.size(F.array_except("names", F.array(*map(F.lit, there)).cast("array<string>"))) > 0
    sure = found.where("code IS NOT NULL").select(*keys, F.when(missing, "READ_ONLY_VIOLATION").otherwise(F.col("code")).alias("code"))
    open_ = found.where("code IS NULL")
    walked = []
    # creating a frame makes the session the thread's own, whose settings the parser takes
    with ThreadPoolExecutor(8, initializer=spark.createDataFrame, initargs=([], "x long")) as pool:
        for batch in batched(open_.toLocalIterator(), 1024):
            walked += [(*[r[k] for k in keys], code) for r, code in zip(batch, pool.map(lambda r: code_of(spark, r.statement, known), batch))]
    return sure.unionByName(spark.createDataFrame(walked, sure.schema)) if walked else sure


def code_of(spark: SparkSession, text: str, known: dict) -> str:
    try:
        check(spark, text, known)
    except GraphError as e:
        return e.code
    return ""


def read_only_sql(spark: SparkSession, text: str, args: dict | list | None = None) -> DataFrame:
    check(spark, text)
    return spark.sql(text, args)
