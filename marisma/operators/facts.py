"""Metric facts: filters, joins, aggregations and series over the long fact and the star schema.

The long fact has one row per (categoria, provincia, anio, mes, periodo_tipo,
metrica_nombre).  Dimension tables are joined without hints: Spark broadcasts a
side whose statistics are under the session threshold and shuffles otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv
from marisma.functions import times

VALUE = "metrica_valor"


def average(col: str) -> Column:
    return F.sum(col).cast("double") / F.count(col)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null where the whole is zero."""
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


# ---------------------------------------------------------------- parameters

def expand_categories(requested: Column, valid: list[str] | None = None,
                      fallback: str = fv.FALLBACK_CATEGORY,
                      companions: list[str] | None = None) -> Column:
    """Unknown names bring in the fallback category, which brings in its companions."""
    known = F.array(*[F.lit(c) for c in (valid or list(fv.REPORT_CATEGORIES.values()))])
    kept = F.filter(requested, lambda c: F.array_contains(known, c))
    kept = F.when(F.size(kept) < F.size(requested), F.concat(kept, F.array(F.lit(fallback)))).otherwise(kept)
    extra = F.array(*[F.lit(c) for c in (companions or fv.FALLBACK_COMPANIONS)])
    full = F.when(F.array_contains(kept, fallback), F.concat(kept, extra)).otherwise(kept)
    return F.array_distinct(full)


def metric_terms(metrics: list[str], categories: list[str]) -> list[str]:
    """Search terms for metric names, with the synonyms the categories call for."""
    terms: dict[str, None] = {}
    for metric in (m.lower() for m in metrics):
        terms[metric] = None
        if fv.CRUISE_CATEGORY in categories and any(t in metric for t in fv.TOURIST_TERMS):
            terms.update(dict.fromkeys(fv.CRUISE_SYNONYMS))
        if set(categories) & set(fv.FOREIGN_CATEGORIES) and any(t in metric for t in fv.FOREIGN_TERMS):
            terms.update(dict.fromkeys(fv.FOREIGN_SYNONYMS))
    return list(terms)


def match_metric_name(name: Column, terms: list[str]) -> Column:
    """Case-insensitive: the name holds any of the terms."""
    low = F.lower(name)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms])


def filter_metrics(df: DataFrame, categorias=None, provincias=None, meses=None, anios=None,
                   periodo_tipo=None, metricas=None) -> DataFrame:
    """Conjunction of the given conditions; an empty list is no condition."""
    if categorias:
        df = df.filter(F.col("categoria").isin(list(categorias)))
    if provincias:
        df = df.filter(F.col("provincia").isin([p.capitalize() for p in provincias]))
    if meses:
        df = df.filter(F.col("mes").isin(list(meses)))
    if anios:
        df = df.filter(F.col("anio").isin(list(anios)))
    if periodo_tipo:
        df = df.filter(F.col("periodo_tipo") == times.query_period_type(F.lit(periodo_tipo)))
    if metricas:
        terms = metric_terms(metricas, list(categorias or []))
        df = df.filter(match_metric_name(F.col("metrica_nombre"), terms))
    return df


def any_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.filter(F.coalesce(*[F.col(c) for c in cols]).isNotNull())


# ---------------------------------------------------------------- aggregations

def aggregate_metrics(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Total, mean and row count per category, year and metric, newest year first; limit: the size of a report, all groups by default."""
    out = (
        df.groupBy("categoria", "anio", F.col("metrica_nombre").alias("metrica"))
        .agg(
            F.sum(VALUE).alias("total"),
            average(VALUE).alias("promedio"),
            F.count("*").alias("registros"),
        )
        .orderBy(F.desc("anio"), "categoria", "metrica")
    )
    return out if limit is None else out.limit(limit)


def list_metrics(df: DataFrame, limit: int | None = None, tiebreak: tuple[str, ...] = ("categoria", "metrica_nombre")) -> DataFrame:
    """Newest rows first; limit: the size of a report, all rows by default."""
    out = df.orderBy(F.desc("anio"), F.desc("mes"), *tiebreak)
    return out if limit is None else out.limit(limit)


def top_values(df: DataFrame, value: str = VALUE, n: int = 10, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).orderBy(F.desc(value), *tiebreak).limit(n)


def year_category_totals(df: DataFrame) -> DataFrame:
    """Sums per year and category, with the year subtotal as the row whose level is 1."""
    return (
        df.rollup("anio", "categoria")
        .agg(F.sum(VALUE).alias("total"), F.grouping_id().cast("int").alias("nivel"))
        .filter(F.col("nivel") < 3)
    )


def change_columns(df: DataFrame, current: str, previous: str) -> DataFrame:
    diff = F.col(current) - F.col(previous)
    return df.withColumns({"diferencia": diff, "variacion_pct": percent(diff, F.col(previous))})


def year_over_year(df: DataFrame, keys: list[str]) -> DataFrame:
    """Year totals per key against the previous year that has data."""
    totals = df.groupBy(*keys, "anio").agg(F.sum(VALUE).alias("total"))
    by_key = W.partitionBy(*keys).orderBy("anio")
    return change_columns(totals.withColumn("total_previo", F.lag("total").over(by_key)), "total", "total_previo")


def same_month_last_year(df: DataFrame, keys: list[str]) -> DataFrame:
    """Month totals against the same month one year earlier: a self join, so gaps stay gaps.  Null keys are keys."""
    parts = [*keys, "anio", "mes"]
    now = df.groupBy(*parts).agg(F.sum(VALUE).alias("total"))
    next_year = {k: F.col(k) + 1 if k == "anio" else F.col(k) for k in parts}
    before = now.select(*[c.alias(f"_{k}") for k, c in next_year.items()], F.col("total").alias("total_previo"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in parts])
    return change_columns(now.join(before, same, "left").drop(*[f"_{k}" for k in parts]), "total", "total_previo")


def coverage_gaps(df: DataFrame, requested: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, anio, categoria) that were asked for and have no rows, in every year the keys by have any.  Null keys are keys."""
    keys = [*(by or []), "anio"]
    present = df.select(*keys, "categoria").distinct()
    wanted = present.select(*keys).distinct().withColumn("categoria", F.explode(F.array(*[F.lit(c) for c in requested])))
    there = present.select(*[F.col(k).alias(f"_{k}") for k in present.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in present.columns])
    return wanted.join(there, same, "left_anti")


def pivot_values(df: DataFrame, keys: list[str], code: str, value: str, codes: list[str], how=F.max) -> DataFrame:
    """One column per code, as conditional aggregates: the code list is fixed, so one shuffle is enough."""
    return df.groupBy(*keys).agg(*[how(F.when(F.col(code) == c, F.col(value))).alias(c) for c in codes])


def pivot_measures(df: DataFrame, keys: list[str], code: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One column per (code, measure), as conditional aggregates."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(code) == c, F.col(m))).alias(name) for name, (c, m) in columns.items()])


def merge_sections(df: DataFrame, keys: list[str], section: str, value: str, order: str, sections: list[str]) -> DataFrame:
    """One wide row per key with the last value of every section."""
    return df.groupBy(*keys).agg(
        *[F.max_by(value, F.when(F.col(section) == s, F.col(order))).alias(s) for s in sections]
    )


def first_match(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def last_match(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def compare_entities(df: DataFrame, entity: str, left: str, right: str, keys: list[str]) -> DataFrame:
    """Totals of two entities side by side, with their difference."""
    wide = (
        df.filter(F.col(entity).isin(left, right))
        .groupBy(*keys)
        .agg(
            F.sum(F.when(F.col(entity) == left, F.col(VALUE))).alias("total_a"),
            F.sum(F.when(F.col(entity) == right, F.col(VALUE))).alias("total_b"),
        )
    )
    return change_columns(wide, "total_b", "total_a")


def compare_periods(df: DataFrame, keys: list[str], current: Column, previous: Column) -> DataFrame:
    """Two periods of the same rows by conditional sums: one pass, no self join."""
    wide = (
        df.filter(current | previous)
        .groupBy(*keys)
        .agg(
            F.sum(F.when(current, F.col(VALUE))).alias("total"),
            F.sum(F.when(previous, F.col(VALUE))).alias("total_previo"),
        )
    )
    return change_columns(wide, "total", "total_previo")


def share_of_total(df: DataFrame, keys: list[str], part: Column) -> DataFrame:
    """Share of the rows that satisfy the condition."""
    out = df.groupBy(*keys).agg(
        F.sum(F.when(part, F.col(VALUE))).alias("parte"), F.sum(VALUE).alias("total")
    )
    return out.withColumn("cuota_pct", percent(F.col("parte"), F.col("total")))


# ---------------------------------------------------------------- star schema

def with_fact_keys(df: DataFrame) -> DataFrame:
    """Derived key columns of the fact: null dimensions count as zero."""
    return df.withColumns(
        {
            "date_id": times.date_id(F.col("anio"), F.col("mes")),
            "fecha_periodo": times.first_of_month(F.col("anio"), F.col("mes")),
            "prov_key": F.coalesce("id_provincia", F.lit(0)),
            "mercado_key": F.coalesce("id_mercado", F.lit(0)),
            "tipo_key": F.coalesce("id_tipo_turismo", F.lit(0)),
        }
    )


SCOPES = ("region", "provincia", "mercado", "tipo")


def scoped_facts(fact: DataFrame, indicadores: DataFrame, scope: str, dim: DataFrame | None = None) -> DataFrame:
    """Fact rows of one scope with the names of their indicator and dimension."""
    if scope == "region":
        rows = fact.filter(
            (F.col("ambito_geografico") == "andalucia")
            & F.col("id_provincia").isNull() & F.col("id_mercado").isNull() & F.col("id_tipo_turismo").isNull()
        )
    elif scope == "provincia":
        rows = fact.filter(F.col("ambito_geografico") == "provincia").join(dim, "id_provincia")
    elif scope == "mercado":
        rows = fact.filter(F.col("id_mercado").isNotNull()).join(dim, "id_mercado")
    elif scope == "tipo":
        rows = fact.filter(F.col("id_tipo_turismo").isNotNull()).join(dim, "id_tipo_turismo")
    else:
        raise ValueError(f"unknown scope: {scope}")
    names = {"provincia": ["codigo_provincia", "nombre_provincia"],
             "mercado": ["codigo_mercado", "nombre_mercado", "tipo_mercado"],
             "tipo": ["codigo_tipo", "nombre_tipo"]}.get(scope, [])
    return rows.join(indicadores, "id_indicador").select(
        "anio", "mes", "fecha_periodo", *names,
        "codigo_indicador", "nombre_indicador", "unidad_medida",
        "valor_absoluto", "variacion_interanual",
    )


def wide_kpis(fact: DataFrame, calendario: DataFrame, provincias: DataFrame, mercados: DataFrame,
              tipos: DataFrame, indicadores: DataFrame, kpis: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per period and dimension members, one column per indicator measure.

    The fact is pivoted on its surrogate keys first (partial aggregation, no
    names in the shuffle); the names are joined to the much smaller result.
    """
    kpis = kpis or fv.KPI_COLUMNS
    keys = ["anio", "mes", "fecha_periodo", "date_id", "id_provincia", "id_mercado", "id_tipo_turismo"]
    named = fact.join(indicadores.select("id_indicador", "codigo_indicador"), "id_indicador", "left")
    wide = pivot_measures(named, keys, "codigo_indicador", kpis)
    return (
        wide.join(calendario.select("date_id", "mes_nombre_es", "trimestre", "semestre"), "date_id", "left")
        .join(provincias.select("id_provincia", "codigo_provincia", "nombre_provincia"), "id_provincia", "left")
        .join(mercados.select("id_mercado", "codigo_mercado", "nombre_mercado", "tipo_mercado"), "id_mercado", "left")
        .join(tipos.select("id_tipo_turismo", "codigo_tipo", "nombre_tipo"), "id_tipo_turismo", "left")
        .select(
            "anio", "mes", "fecha_periodo", "date_id", "mes_nombre_es", "trimestre", "semestre",
            "codigo_provincia", "nombre_provincia", "codigo_mercado", "nombre_mercado", "tipo_mercado",
            "codigo_tipo", "nombre_tipo", *kpis,
        )
    )


def period_report(fact: DataFrame, provincias: DataFrame, mercados: DataFrame, tipos: DataFrame,
                  indicadores: DataFrame, date_id: int) -> DataFrame:
    """All facts of one month with names; a missing dimension reads as its total."""
    return (
        fact.filter(F.col("date_id") == date_id)
        .join(indicadores, "id_indicador")
        .join(provincias, "id_provincia", "left")
        .join(mercados, "id_mercado", "left")
        .join(tipos, "id_tipo_turismo", "left")
        .select(
            F.coalesce("nombre_provincia", F.lit(fv.ALL_PROVINCES_LABEL)).alias("provincia"),
            F.coalesce("nombre_mercado", F.lit(fv.ALL_MARKETS_LABEL)).alias("mercado"),
            F.coalesce("nombre_tipo", F.lit(fv.ALL_TYPES_LABEL)).alias("tipo_turismo"),
            F.col("nombre_indicador").alias("indicador"),
            F.col("valor_absoluto").alias("valor"),
            F.col("variacion_interanual").alias("variacion"),
            F.col("fecha_periodo").alias("fecha"),
        )
        .orderBy("provincia", "mercado", "tipo_turismo", "indicador")
    )


# ---------------------------------------------------------------- lookups

def alias_keys(dim: DataFrame, aliases: DataFrame, id_col: str, code: str, name: str) -> DataFrame:
    """(clave, id): every spelling under which a member can be found, lower case."""
    keys = dim.select(F.lower(name).alias("clave"), id_col)
    keys = keys.unionByName(dim.select(F.lower(code).alias("clave"), id_col))
    keys = keys.unionByName(aliases.select(F.lower("alias").alias("clave"), id_col))
    return keys.distinct()


def lookup_alias(questions: DataFrame, dim: DataFrame, aliases: DataFrame, id_col: str, code: str,
                 name: str, term: str = "termino") -> DataFrame:
    """Match a term on name, code or alias: one equi join instead of a three-way OR."""
    keys = alias_keys(dim, aliases, id_col, code, name)
    hits = questions.withColumn("clave", F.lower(term)).join(keys, "clave").select(term, id_col).distinct()
    return hits.join(dim.select(id_col, code, name), id_col).select(term, id_col, code, name)


def _grams(word: Column, width: int) -> Column:
    """Distinct substrings of a width; a word that is shorter has none."""
    size = F.length(word)
    return F.when(
        size >= width, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - width + 1, F.lit(1))), lambda i: F.substr(word, i, F.lit(width))))
    ).otherwise(F.array().cast("array<string>"))


def contains_join(texts: DataFrame, text: str, terms: DataFrame, term: str, width: int = 3) -> DataFrame:
    """Pairs where the text holds the term, ignoring case, as equi joins over the texts' vocabulary.

    A text that holds a term has a word that holds the term's longest piece without a blank.  Those words
    are looked up in the distinct words of all texts: of a piece's n-grams the one that fewest words
    have is joined, and the full condition is checked on the pairs that meet.  The texts themselves are
    joined by word, so they give a row per distinct word and none per character.  Terms of blanks alone are
    held by texts that have as many in a row; an empty term by none.
    """
    low_text, low_term = F.lower(text), F.lower(term)
    asked = terms.filter(F.length(low_term) > 0).withColumn("_pieces", F.filter(F.split(low_term, " "), lambda x: x != ""))
    piece = F.array_max(F.transform("_pieces", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    asked = asked.withColumn("_piece", F.coalesce(piece, F.lit(" "))).drop("_pieces")
    # a blank is a word like others, for terms that are nothing else
    words = F.array_distinct(F.concat(F.filter(F.split(low_text, " "), lambda x: x != ""), F.when(F.contains(low_text, F.lit(" ")), F.array(F.lit(" "))).otherwise(F.array().cast("array<string>"))))
    placed = texts.withColumn("_word", F.explode(words))
    vocabulary = placed.select("_word").distinct()

    every = F.flatten(F.array(*[_grams(F.col("_word"), n) for n in range(1, width + 1)]))
    grams = vocabulary.select("_word", F.explode(every).alias("_gram"))
    counts = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    pieces = asked.select("_piece").distinct()
    own = F.when(F.length("_piece") >= width, _grams(F.col("_piece"), width)).otherwise(F.array("_piece"))
    # a gram that no word has leaves the piece without an answer
    rarest = (
        pieces.select("_piece", F.explode(own).alias("_gram")).join(counts, "_gram", "left")
        .groupBy("_piece").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram"))).alias("_r"))
        .filter("_r.n > 0").select("_piece", F.col("_r._gram").alias("_gram"))
    )
    held = rarest.join(grams, "_gram").filter(F.contains("_word", F.col("_piece"))).select("_piece", "_word")
    met = placed.join(held, "_word").join(asked, "_piece").filter(F.contains(low_text, low_term))
    return met.drop("_word", "_piece").dropDuplicates([*texts.columns, term])


def lookup_contains(questions: DataFrame, dim: DataFrame, aliases: DataFrame, id_col: str, code: str,
                    name: str, term: str = "termino") -> DataFrame:
    """Match a term inside the name, or exactly on code or alias."""
    inside = contains_join(dim.select(id_col, name), name, questions.select(term).distinct(), term).select(term, id_col)
    exact_keys = dim.select(F.lower(code).alias("clave"), id_col).unionByName(
        aliases.select(F.lower("alias").alias("clave"), id_col)
    )
    exact = questions.withColumn("clave", F.lower(term)).join(exact_keys, "clave").select(term, id_col)
    hits = inside.unionByName(exact).distinct()
    return hits.join(dim.select(id_col, code, name), id_col).select(term, id_col, code, name)


def resolve_codes(rows: DataFrame, dims: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Codes to surrogate ids; an unknown or missing code gives a null id.

    dims: (dimension, its code column, its id column, the code column of the rows)
    """
    for dim, code, id_col, row_code in dims:
        small = dim.select(F.col(code).alias(row_code), id_col)
        rows = rows.join(small, row_code, "left")
    return rows


def scope_of_token(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(ambito, valor) of a file token: province, market, segment, total or unknown."""
    markets = [code for code, _, _ in fv.MARKETS]
    low = F.lower(token)
    folded = F.translate(low, "-óñ", "_on")

    def among(col: Column, names) -> Column:
        return col.isin(list(names))

    scope = (
        F.when(among(low, fv.PROVINCE_CODES), F.struct(F.lit("provincia").alias("ambito"), low.alias("valor")))
        .when(among(low, markets), F.struct(F.lit("mercado").alias("ambito"), low.alias("valor")))
        .when(among(low, fv.SEGMENTS), F.struct(F.lit("segmento").alias("ambito"), low.alias("valor")))
        .when(among(folded, markets), F.struct(F.lit("mercado").alias("ambito"), folded.alias("valor")))
        .when(among(folded, fv.SEGMENTS), F.struct(F.lit("segmento").alias("ambito"), folded.alias("valor")))
        .when(F.contains(folded, F.lit("total")),
              F.struct(F.lit("total").alias("ambito"), F.lit("total_turistas").alias("valor")))
        .otherwise(F.struct(F.lit("desconocido").alias("ambito"), low.alias("valor")))
    )
    return tokens.withColumn("_scope", scope).select("*", "_scope.ambito", "_scope.valor").drop("_scope")


def classify_by_dictionaries(tokens: DataFrame, token: str, dictionaries: list[tuple[str, DataFrame, str]],
                             default: str = "desconocido") -> DataFrame:
    """Scope from dictionary tables of any size; the first dictionary in the list wins.

    dictionaries: (scope name, table, key column)
    """
    entries = reduce(
        DataFrame.unionByName,
        [
            table.select(F.lower(key).alias("_key"), F.struct(F.lit(rank).alias("rank"), F.lit(scope).alias("ambito")).alias("hit"))
            for rank, (scope, table, key) in enumerate(dictionaries)
        ],
    )
    best = entries.groupBy("_key").agg(F.min("hit").alias("hit"))
    return (
        tokens.withColumn("_key", F.lower(token))
        .join(best, "_key", "left")
        .withColumn("ambito", F.coalesce("hit.ambito", F.lit(default)))
        .drop("_key", "hit")
    )
