"""Role-scoped column access: grants, effective columns, role views, denial.

Grants and catalogs are *policy metadata* (roles × tables × columns, a few
thousand rows even for a large estate); they are kept as small DataFrames and
joined with ``broadcast``. Table *data* is never touched by the policy code:
a role's view is ``base.select(*visible)``, so Catalyst's column pruning drops
hidden columns from the Parquet ``ReadSchema`` and they are never read.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.functions.joins import broadcast_if_small, values_frame
from veilgrid.sources.catalog import append_by_name

PUBLIC = "*"

GRANTS_SCHEMA = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("database", T.StringType()),
        T.StructField("table", T.StringType()),  # NULL = database-level grant
        T.StructField("columns", T.ArrayType(T.StringType())),  # NULL = all columns
        T.StructField("permissions", T.ArrayType(T.StringType())),
    ]
)

CATALOG_COLUMNS_SCHEMA = T.StructType(
    [
        T.StructField("database", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("data_type", T.StringType()),
    ]
)


class AccessDenied(PermissionError):
    """A role asked for a table, database or column it was not granted."""

    def __init__(self, role: str, table: str, column: str | None = None):
        self.role, self.table, self.column = role, table, column
        what = f"column {column!r} of {table}" if column else table
        super().__init__(f"role {role!r} may not read {what}")


# ---------------------------------------------------------------- grants


def grants_frame(spark: SparkSession, rows: Iterable[Sequence] = ()) -> DataFrame:
    """Grants as a DataFrame ``(role, database, table, columns, permissions)``."""
    return values_frame(spark, rows, GRANTS_SCHEMA)


def grant(
    grants: DataFrame,
    role: str,
    database: str,
    table: str | None = None,
    columns: Sequence[str] | None = None,
    permissions: Sequence[str] = ("SELECT",),
) -> DataFrame:
    """Append one grant: full table (``columns=None``), column list, or database level.

    ``role=PUBLIC`` grants to every role (``GRANT … TO PUBLIC``).
    """
    row = grants_frame(
        grants.sparkSession, [(role, database, table, list(columns) if columns is not None else None, list(permissions))]
    )
    return grants.unionByName(row)


def allowed_columns(all_columns: Column, restricted: Column) -> Column:
    """All − restricted, table order and duplicates kept (``array_except`` would drop them)."""
    return F.filter(all_columns, lambda c: ~F.array_contains(restricted, c))


def revoke(grants: DataFrame, revocations: DataFrame) -> DataFrame:
    """Drop the grants of ``revocations (role, database, table)``; table NULL matches NULL.

    Revocations are a handful of policy rows, broadcast into an anti join.
    """
    r = revocations.select("role", "database", "table")
    cond = (
        (grants["role"] == r["role"])
        & (grants["database"] == r["database"])
        & grants["table"].eqNullSafe(r["table"])
    )
    return grants.join(broadcast_if_small(r), cond, "left_anti")


def with_permission(grants: DataFrame, permission: str) -> DataFrame:
    """Grants that carry ``permission`` (or ALL)."""
    p = F.col("permissions")
    return grants.filter(F.array_contains(p, permission) | F.array_contains(p, "ALL"))


# ---------------------------------------------------------------- catalog metadata


def catalog_columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(database, table, column, position, data_type)`` from the schemas of ``db.table`` frames."""
    rows = []
    for qname, df in tables.items():
        db, tbl = split_name(qname)
        for i, f in enumerate(df.schema.fields):
            rows.append((db, tbl, f.name, i, f.dataType.simpleString()))
    return values_frame(spark, rows, CATALOG_COLUMNS_SCHEMA)


def split_name(qname: str) -> tuple[str, str]:
    if "." not in qname:
        raise ValueError(f"table name must be database.table: {qname!r}")
    db, tbl = qname.split(".", 1)
    return db, tbl


def visible_databases(grants: DataFrame, databases: DataFrame, role: str) -> DataFrame:
    """Databases a role may DESCRIBE (its own or PUBLIC database-level grants); semi join."""
    g = with_permission(grants, "DESCRIBE").filter(
        F.col("table").isNull() & F.col("role").isin(role, PUBLIC)
    )
    return databases.join(broadcast_if_small(g.select("database")), "database", "left_semi")


# ---------------------------------------------------------------- effective columns


def effective_columns(grants: DataFrame, catalog: DataFrame, roles: Sequence[str] | None = None) -> DataFrame:
    """Visible columns per (role, database, table): the **union** of SELECT grants.

    A full-table grant (``columns`` NULL) gives every column, so it wins over a
    column list. Listed names not in the catalog are ignored. PUBLIC grants are
    given to every role in ``roles`` (the role list is policy config).
    Output: ``role, database, table, columns (table order), full_table``.
    """
    g = with_permission(grants, "SELECT").filter(F.col("table").isNotNull())
    if roles:
        public = g.filter(F.col("role") == PUBLIC).withColumn(
            "role", F.explode(F.array(*[F.lit(r) for r in roles]))
        )
        g = g.filter(F.col("role") != PUBLIC).unionByName(public)
    cat = broadcast_if_small(catalog.select("database", "table", "column", "position"))
    full = g.filter(F.col("columns").isNull()).select("role", "database", "table").join(cat, ["database", "table"])
    listed = (
        g.filter(F.col("columns").isNotNull())
        .select("role", "database", "table", F.explode("columns").alias("column"))
        .join(cat, ["database", "table", "column"])
    )
    flagged = full.withColumn("full", F.lit(True)).unionByName(listed.withColumn("full", F.lit(False)))
    return (
        flagged.groupBy("role", "database", "table")
        .agg(
            F.array_sort(F.collect_set(F.struct("position", "column"))).alias("_cols"),
            F.max("full").alias("full_table"),
        )
        .select(
            "role",
            "database",
            "table",
            F.transform("_cols", lambda s: s["column"]).alias("columns"),
            "full_table",
        )
    )


def grant_conflicts(grants: DataFrame) -> DataFrame:
    """Roles holding both a full-table and a column-list SELECT grant on one table."""
    g = with_permission(grants, "SELECT").filter(F.col("table").isNotNull())
    return (
        g.groupBy("role", "database", "table")
        .agg(
            F.max(F.col("columns").isNull()).alias("has_full"),
            F.max(F.col("columns").isNotNull()).alias("has_list"),
        )
        .filter(F.col("has_full") & F.col("has_list"))
        .select("role", "database", "table")
    )


def hidden_columns(effective: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per (role, database, table): visible columns, hidden columns and counts."""
    all_cols = (
        catalog.groupBy("database", "table")
        .agg(F.array_sort(F.collect_list(F.struct("position", "column"))).alias("_all"))
        .select("database", "table", F.transform("_all", lambda s: s["column"]).alias("all_columns"))
    )
    return (
        effective.join(broadcast_if_small(all_cols), ["database", "table"])
        .withColumn("hidden", allowed_columns(F.col("all_columns"), F.col("columns")))
        .withColumn("n_visible", F.size("columns"))
        .withColumn("n_total", F.size("all_columns"))
    )


def grant_write(
    grants: DataFrame,
    role: str,
    candidates: Sequence[tuple[str, str]],
    catalog_tables: DataFrame,
    permissions: Sequence[str] = ("INSERT", "ALTER"),
) -> DataFrame:
    """Give ``role`` write permissions on the first candidate table that exists."""
    spark = grants.sparkSession
    cands = values_frame(spark, [(i, db, t) for i, (db, t) in enumerate(candidates)], "pos int, database string, table string")
    first = (
        cands.join(broadcast_if_small(catalog_tables.select("database", "table").distinct()), ["database", "table"])
        .agg(F.min_by(F.struct("database", "table"), F.col("pos")).alias("t"))
        .filter(F.col("t").isNotNull())
        .select(
            F.lit(role).alias("role"),
            F.col("t.database").alias("database"),
            F.col("t.table").alias("table"),
            F.lit(None).cast("array<string>").alias("columns"),
            F.array(*[F.lit(p) for p in permissions]).alias("permissions"),
        )
    )
    return grants.unionByName(first)


def may_write(grants: DataFrame, role: str, database: str, table: str, permission: str = "INSERT") -> bool:
    """Does ``role`` (or PUBLIC) hold ``permission`` (or ALL) on the table or its database?

    One bounded look-up in the grants (policy metadata), not a data scan.
    """
    g = with_permission(grants, permission).filter(
        F.col("role").isin(role, PUBLIC)
        & (F.col("database") == database)
        & (F.col("table").isNull() | (F.col("table") == table))
    )
    return bool(g.limit(1).collect())


def governed_append(grants: DataFrame, role: str, table: str, df: DataFrame) -> None:
    """Append ``df`` to catalog table ``db.table`` as ``role``.

    Writes need INSERT; read grants (and their column lists) do not govern
    writes, so the row is written with every column it names — hidden ones
    included — matched by name, absent columns NULL. A column that the table
    does not have raises.
    """
    db, tbl = split_name(table)
    if not may_write(grants, role, db, tbl):
        raise AccessDenied(role, table)
    append_by_name(df, table)


# ---------------------------------------------------------------- governed access


# What a parsed query may consist of; anything else is a command, or reads something that is no bound table.
QUERY_NODES = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias "
    "UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedInlineTable UnresolvedHint "
    "OneRowRelation Generate Pivot Unpivot WithWindowDefinition Sample RepartitionByExpression".split()
)


def _each(seq) -> list:
    """A Scala sequence as a list."""
    return [seq.apply(i) for i in range(seq.length())]


class Governor:
    """Resolves every request of a role against that role's view only.

    ``tables`` maps ``db.table`` to a DataFrame (usually a Parquet scan).
    The policy — visible column names per (role, table) — is metadata and is
    computed once; it is a few names per table, never table data.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, DataFrame],
        grants: DataFrame,
        roles: Sequence[str] | None = None,
    ):
        self.spark = spark
        self.tables = dict(tables)
        self.grants = grants
        self.catalog = catalog_columns(spark, self.tables)
        if roles is None:
            roles = [r["role"] for r in grants.select("role").distinct().collect() if r["role"] != PUBLIC]
        self.roles = list(roles)
        self.effective = effective_columns(grants, self.catalog, self.roles)
        self._policy: dict[tuple[str, str], list[str]] = {
            (r["role"], f"{r['database']}.{r['table']}"): list(r["columns"]) for r in self.effective.collect()
        }

    # -- policy look-ups
    def visible(self, role: str, table: str) -> list[str]:
        if table not in self.tables:
            raise AccessDenied(role, table)
        cols = self._policy.get((role, table))
        if cols is None:
            raise AccessDenied(role, table)
        return list(cols)

    def hidden(self, role: str, table: str) -> list[str]:
        vis = set(self.visible(role, table))
        return [c for c in self.tables[table].columns if c not in vis]

    def granted_tables(self, role: str) -> list[str]:
        return sorted(t for (r, t) in self._policy if r == role)

    # -- data access
    def view(self, role: str, table: str) -> DataFrame:
        """The role's view of ``table``: only its visible columns, in table order.

        The alias closes it: Spark looks for a name that a projection lacks in
        the projection's input, but not through an alias, so a later
        ``filter`` or ``orderBy`` cannot reach a hidden column either.
        """
        cols = self.visible(role, table)  # denies unknown or ungranted tables first
        return self.tables[table].select(*cols).alias(split_name(table)[1])

    def select(self, role: str, table: str, cols: str | Sequence[str | Column] = "*") -> DataFrame:
        """``SELECT *`` (expanded after the role's columns are known) or a column list.

        Any column outside the role's view raises ``AccessDenied``; expressions
        are resolved against the view, so a hidden name inside them fails too.
        """
        v = self.view(role, table)
        if cols == "*":
            return v
        hidden = {c.lower() for c in self.hidden(role, table)}
        for c in cols:
            if isinstance(c, str) and c.lower() in hidden:
                raise AccessDenied(role, table, c)
        return self._guard(role, table, lambda: v.select(*cols)).alias(split_name(table)[1])

    def sql(self, role: str, query: str, **args) -> DataFrame:
        """Run a SQL query as ``role``; tables are written ``{table}`` and bind to the role's views.

        PySpark binds each ``{name}`` to a DataFrame under a generated view
        name, so roles never share view names. A hidden column anywhere
        (SELECT, WHERE, ORDER BY, expressions) is unresolved and becomes
        ``AccessDenied``; so is a table that is not granted, any relation that
        is not a placeholder (base tables, files), and any statement that is
        not a query. A name that several databases have is ambiguous.
        """
        views: dict[str, DataFrame] = {}
        for _, name, _, _ in string.Formatter().parse(query):
            if not name or name in args or name in views:
                continue
            matches = [t for t in self.tables if t == name or t.split(".", 1)[1] == name]
            if not matches:
                raise AccessDenied(role, name)
            if len(matches) > 1:
                raise ValueError(f"table name {name!r} is ambiguous: {sorted(matches)}")
            views[name] = self.view(role, matches[0])
        self._only_bound(role, query, views, args)
        try:
            return self.spark.sql(query, **views, **args).alias("result")
        except AnalysisException as e:
            raise self._translate(role, e) from e

    def _only_bound(self, role: str, query: str, views: Mapping[str, DataFrame], args: Mapping) -> None:
        """Refuse a statement that is no query, or names a relation that is neither a placeholder nor a CTE in its scope.

        Scopes are Spark's: a CTE is seen by the ones after it and by its own
        query, with their subqueries, but not by its own body and not outside
        that query. WITH RECURSIVE, whose body does see itself, is refused. A
        name of several parts is never a CTE. Needs the session's parser; a
        session without one (Spark Connect) gets a refusal.
        """
        session = getattr(self.spark, "_jsparkSession", None)
        if session is None:
            raise AccessDenied(role, "SQL text without a parser to check it")
        bound = {name: f"__bound_{i}" for i, name in enumerate(views)}
        text = query.format(**bound, **dict.fromkeys(args, "NULL"))
        as_named = str if self.spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower
        known = frozenset(as_named(x) for x in bound.values())
        todo = [(session.sessionState().sqlParser().parsePlan(text), known)]
        while todo:
            node, scope = todo.pop()
            kind = node.getClass().getSimpleName()
            if kind == "UnresolvedRelation":
                parts = _each(node.multipartIdentifier())
                if len(parts) != 1 or as_named(parts[0]) not in scope:
                    raise AccessDenied(role, ".".join(parts))
            elif kind == "UnresolvedWith":
                if node.allowRecursion():
                    raise AccessDenied(role, "statement WITH RECURSIVE")
                for part in _each(node.cteRelations()):
                    todo.append((part.productElement(1), scope))
                    scope = scope | {as_named(part.productElement(0))}
            elif kind.rstrip("$") not in QUERY_NODES:
                raise AccessDenied(role, f"statement {kind}")
            todo += [(x, scope) for x in [*_each(node.children()), *_each(node.subqueries())]]

    def create_role_schema(self, role: str, alias_db: str) -> list[str]:
        """Permanent views ``alias_db.table`` with only the role's columns.

        Needs the base tables registered in the catalog under ``db.table``.
        """
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{alias_db}`")
        made = []
        for t in self.granted_tables(role):
            db, tbl = split_name(t)
            cols = ", ".join(f"`{c}`" for c in self.visible(role, t))
            self.spark.sql(f"CREATE OR REPLACE VIEW `{alias_db}`.`{tbl}` AS SELECT {cols} FROM `{db}`.`{tbl}`")
            made.append(f"{alias_db}.{tbl}")
        return made

    # -- error mapping
    def _guard(self, role: str, table: str, build):
        try:
            return build()
        except AnalysisException as e:
            raise self._translate(role, e, table) from e

    def _translate(self, role: str, e: AnalysisException, table: str | None = None) -> Exception:
        cond = e.getCondition() or ""
        params = e.getMessageParameters() or {}
        if cond.startswith("UNRESOLVED_COLUMN") or cond.startswith("UNRESOLVED_FIELD"):
            name = params.get("objectName", "").split(".")[-1].strip("`")
            tables = [table] if table else self.granted_tables(role)
            for t in tables:
                if name.lower() in {c.lower() for c in self.tables[t].columns}:
                    return AccessDenied(role, t, name)
        if cond.startswith("TABLE_OR_VIEW_NOT_FOUND"):
            return AccessDenied(role, params.get("relationName", "?").strip("`"))
        return e
