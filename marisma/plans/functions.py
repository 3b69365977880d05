"""SQL table functions over registered views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from marisma.functions import fixed_values as fv


def register_member_lookup(spark: SparkSession, name: str, dim: str, aliases: str, id_col: str, code: str, label: str) -> None:
    """name(term): members whose name, code or alias equals the term, ignoring case.

    The spellings are one union, so a lateral call turns into one equi join.
    """
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(termino_buscado STRING)
        RETURNS TABLE(id BIGINT, codigo STRING, nombre STRING)
        RETURN SELECT DISTINCT d.{id_col}, d.{code}, d.{label}
               FROM (SELECT {id_col} AS k, lower({label}) AS clave FROM {dim}
                     UNION SELECT {id_col}, lower({code}) FROM {dim}
                     UNION SELECT {id_col}, lower(alias) FROM {aliases}) s
               JOIN {dim} d ON d.{id_col} = s.k
               WHERE s.clave = lower(termino_buscado)""")


def register_contains_lookup(spark: SparkSession, name: str, dim: str, aliases: str, id_col: str, code: str, label: str,
                             alias_id: str, width: int = 3) -> None:
    """name(term): members whose name holds the term, or whose code or alias equals it.

    Names are looked up by the first letters of the term, spellings as a whole, both by equality, so a
    lateral call over a table of terms is an equi join.  An empty term is in no name.  The places of a name
    come from a join by length: Spark takes an exploded table for no larger than the one below it and would
    collect it for a broadcast, a join it does not underestimate.
    """
    spark.sql(f"""
        SELECT k, c, v, substr(baja, desde, ancho) AS clave
        FROM (SELECT {id_col} AS k, {code} AS c, {label} AS v, lower({label}) AS baja FROM {dim})
        JOIN (SELECT largo, ancho, explode(sequence(1, greatest(largo - ancho + 1, 1))) AS desde
              FROM (SELECT largo, explode(sequence(1, {width})) AS ancho FROM (SELECT DISTINCT length(lower({label})) AS largo FROM {dim})))
        ON length(baja) = largo""").createOrReplaceTempView(f"{name}_por_letras")
    spark.sql(f"""
        SELECT {id_col} AS k, {code} AS c, {label} AS v, lower({code}) AS clave FROM {dim}
        UNION SELECT d.{id_col}, d.{code}, d.{label}, lower(a.alias) FROM {dim} d JOIN {aliases} a ON d.{id_col} = a.{alias_id}
        """).createOrReplaceTempView(f"{name}_por_clave")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(termino_buscado STRING)
        RETURNS TABLE(id BIGINT, codigo STRING, nombre STRING)
        RETURN SELECT k, c, v FROM {name}_por_letras
               WHERE clave = substr(lower(termino_buscado), 1, {width}) AND clave <> '' AND contains(lower(v), lower(termino_buscado))
               UNION
               SELECT k, c, v FROM {name}_por_clave WHERE clave = lower(termino_buscado)""")


def register_period_function(spark: SparkSession, name: str, fact: str = "datos_turismo") -> None:
    """name(date_id): the facts of a month with the names of their dimensions."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(periodo_buscado INT)
        RETURNS TABLE(provincia STRING, mercado STRING, tipo_turismo STRING, indicador STRING,
                      valor DECIMAL(15,3), variacion DECIMAL(8,6), fecha DATE)
        RETURN SELECT coalesce(p.nombre_provincia, '{fv.ALL_PROVINCES_LABEL}'), coalesce(m.nombre_mercado, '{fv.ALL_MARKETS_LABEL}'),
                      coalesce(t.nombre_tipo, '{fv.ALL_TYPES_LABEL}'), i.nombre_indicador,
                      f.valor_absoluto, f.variacion_interanual, f.fecha_periodo
               FROM {fact} f JOIN indicadores i ON f.id_indicador = i.id_indicador
               LEFT JOIN provincias p ON f.id_provincia = p.id_provincia
               LEFT JOIN mercados m ON f.id_mercado = m.id_mercado
               LEFT JOIN tipos_turismo t ON f.id_tipo_turismo = t.id_tipo_turismo
               WHERE f.date_id = periodo_buscado""")
