"""Ledger queries over the driver's tables, each with its DuckDB form."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posada.operators import integrity, ledger, predicates
from posada.plans.driver_queries import register
from posada.plans.mapping import APUNTE, ASIENTO, LEDGER, apunte, asiento, cuenta

YEAR, FIRST, LAST = 1997, "1997-05-01", "1997-05-31"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.with_headers(apunte(spark, sf_dir), asiento(spark, sf_dir))


_JOINED = f"""{LEDGER}, lineas AS (
  SELECT a.*, s.ejercicio, s.fecha, s.numero, s.tipo, s.estado, s.hoja FROM apunte a JOIN asiento s ON s.id = a.asiento_id)"""
_BASE = _JOINED + f""", base AS (SELECT * FROM lineas WHERE ejercicio = {YEAR} AND estado <> 'anulado' AND tipo <> 'cierre')"""


@register("q01_trial_balance", _BASE + """
SELECT cuenta, CAST(sum(debe) AS DECIMAL(24,2)) AS debe, CAST(sum(haber) AS DECIMAL(24,2)) AS haber, count(*) AS apuntes,
  CAST(sum(debe) - sum(haber) AS DECIMAL(24,2)) AS saldo FROM base WHERE starts_with(cuenta, '4') GROUP BY cuenta""")
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.trial_balance(_lines(spark, sf_dir), YEAR, "4")


@register("a02_trial_balance_totals", _BASE + """, sub AS (SELECT cuenta, sum(debe) AS d, sum(haber) AS h FROM base GROUP BY cuenta)
SELECT CAST(sum(d) AS DECIMAL(24,2)) AS debe, CAST(sum(h) AS DECIMAL(24,2)) AS haber,
  CAST(coalesce(sum(CASE WHEN d > h THEN d - h END), 0) AS DECIMAL(24,2)) AS deudores,
  CAST(coalesce(sum(CASE WHEN d < h THEN h - d END), 0) AS DECIMAL(24,2)) AS acreedores FROM sub""")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.trial_balance_totals(ledger.trial_balance(_lines(spark, sf_dir), YEAR))


def _period_sql(level: int, extra: str = "TRUE", keep: str = "anterior <> 0 OR pd <> 0 OR ph <> 0") -> str:
    return _BASE + f""", g AS (
  SELECT left(cuenta, {level}) AS codigo, count(*) AS apuntes,
    coalesce(sum(CASE WHEN fecha < DATE '{FIRST}' OR tipo = 'apertura' THEN debe - haber END), 0) AS anterior,
    coalesce(sum(CASE WHEN NOT (fecha < DATE '{FIRST}' OR tipo = 'apertura') THEN debe END), 0) AS pd,
    coalesce(sum(CASE WHEN NOT (fecha < DATE '{FIRST}' OR tipo = 'apertura') THEN haber END), 0) AS ph
  FROM base WHERE estado = 'contabilizado' AND fecha <= DATE '{LAST}' AND ({extra}) GROUP BY 1),
periodo AS (
  SELECT codigo, apuntes, CAST(greatest(anterior, 0) AS DECIMAL(24,2)) AS anterior_debe, CAST(greatest(-anterior, 0) AS DECIMAL(24,2)) AS anterior_haber,
    CAST(pd AS DECIMAL(24,2)) AS periodo_debe, CAST(ph AS DECIMAL(24,2)) AS periodo_haber,
    CAST(greatest(anterior, 0) + pd AS DECIMAL(24,2)) AS acumulado_debe, CAST(greatest(-anterior, 0) + ph AS DECIMAL(24,2)) AS acumulado_haber,
    CAST(greatest(anterior + pd - ph, 0) AS DECIMAL(24,2)) AS saldo_deudor, CAST(greatest(ph - pd - anterior, 0) AS DECIMAL(24,2)) AS saldo_acreedor
  FROM g WHERE {keep})"""


@register("q02_period_trial_balance", _period_sql(3) + " SELECT * FROM periodo")
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.period_trial_balance(_lines(spark, sf_dir), YEAR, FIRST, LAST, level=3)


@register("a03_prior_period", _period_sql(8) + " SELECT * FROM periodo")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.period_trial_balance(_lines(spark, sf_dir), YEAR, FIRST, LAST)


@register("p05_code_range", _period_sql(4, "left(cuenta, 1) >= '2' AND left(cuenta, 2) <= '45'") + " SELECT * FROM periodo")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.period_trial_balance(_lines(spark, sf_dir), YEAR, FIRST, LAST, level=4, code_first="2", code_last="45")


@register("j06_accounts_without_movement", _period_sql(4, keep="TRUE") + """, todas AS (SELECT DISTINCT left(cuenta, 4) AS codigo FROM apunte)
SELECT * FROM periodo UNION ALL SELECT codigo, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM todas WHERE codigo NOT IN (SELECT codigo FROM periodo)""")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.period_trial_balance(_lines(spark, sf_dir), YEAR, FIRST, LAST, level=4, accounts=cuenta(spark, sf_dir))


@register("a07_period_checks", _period_sql(8) + """
SELECT *, periodo_debe = periodo_haber AS cuadra_periodo, acumulado_debe = acumulado_haber AS cuadra_acumulado, saldo_deudor = saldo_acreedor AS cuadra_saldos
FROM (SELECT """ + ", ".join(f"CAST(coalesce(sum({c}), 0) AS DECIMAL(24,2)) AS {c}" for c in ledger.SUMS) + " FROM periodo)")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.period_checks(ledger.period_trial_balance(_lines(spark, sf_dir), YEAR, FIRST, LAST))


_ROLLUP = """ SELECT left(cuenta, n) AS codigo, CAST(sum(debe) AS DECIMAL(24,2)) AS debe, CAST(sum(haber) AS DECIMAL(24,2)) AS haber
FROM apunte, (SELECT unnest([1, 2, 3, 4, 5, 8]) AS n) GROUP BY 1"""


@register("a05_all_levels", f"WITH {APUNTE}" + _ROLLUP)
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.all_levels(apunte(spark, sf_dir))


@register("a04_prefix_rollup", f"WITH {APUNTE} SELECT left(cuenta, 3) AS codigo, CAST(sum(debe) AS DECIMAL(24,2)) AS debe, CAST(sum(haber) AS DECIMAL(24,2)) AS haber FROM apunte GROUP BY 1")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apunte(spark, sf_dir).groupBy(ledger.level_key(F.col("cuenta"), 3).alias("codigo")).agg(ledger.total(F.col("debe")).alias("debe"), ledger.total(F.col("haber")).alias("haber"))


_EXTRACT = _BASE + f""", corrido AS (
  SELECT *, CAST(sum(debe - haber) OVER (ORDER BY fecha, numero, orden, cuenta, debe, haber, punteo ROWS UNBOUNDED PRECEDING) AS DECIMAL(24,2)) AS saldo
  FROM base WHERE starts_with(cuenta, '40') AND fecha <= DATE '{LAST}')
SELECT asiento_id, orden, cuenta, debe, haber, punteo, saldo FROM corrido WHERE fecha >= DATE '{FIRST}'"""


def _extract(spark: SparkSession, sf_dir: str, mark: str | None) -> DataFrame:
    found = ledger.extract(_lines(spark, sf_dir), YEAR, "40", FIRST, LAST, mark)
    return found.select("asiento_id", "orden", "cuenta", "debe", "haber", "punteo", "saldo")


@register("q03_ledger_extract", _EXTRACT)
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract(spark, sf_dir, None)


@register("w02_mark_after_balance", _EXTRACT + " AND punteo = ''")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract(spark, sf_dir, "sin")


@register("w01_running_balance", f"""WITH {APUNTE}
SELECT cuenta, asiento_id, orden, CAST(sum(debe - haber) OVER (PARTITION BY cuenta ORDER BY asiento_id, orden, debe, haber, punteo ROWS UNBOUNDED PRECEDING) AS DECIMAL(24,2)) AS saldo FROM apunte""")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.running_balance(apunte(spark, sf_dir), ["cuenta"], ["asiento_id", "orden", "debe", "haber", "punteo"]).select("cuenta", "asiento_id", "orden", "saldo")


@register("q04_counterparts", f"""WITH {APUNTE}, lado AS (SELECT asiento_id, debe > 0 AS al_debe, list_sort(list_distinct(list(cuenta))) AS otras FROM apunte GROUP BY ALL)
SELECT a.asiento_id, a.orden, a.cuenta, CAST(coalesce(len(l.otras), 0) AS BIGINT) AS n_contrapartidas,
  CASE WHEN l.otras IS NULL THEN '' WHEN len(l.otras) = 1 THEN l.otras[1] ELSE 'Varias (' || len(l.otras) || ')' END AS contrapartida
FROM apunte a LEFT JOIN lado l ON l.asiento_id = a.asiento_id AND l.al_debe = NOT (a.debe > 0)""")
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.counterparts(apunte(spark, sf_dir)).select("asiento_id", "orden", "cuenta", "n_contrapartidas", "contrapartida")


@register("q05_journal", f"""{LEDGER}
SELECT s.id, s.fecha, s.estado, CAST(t.d AS DECIMAL(24,2)) AS total_debe, CAST(t.h AS DECIMAL(24,2)) AS total_haber, coalesce(t.n, 0) AS n_apuntes
FROM asiento s LEFT JOIN (SELECT asiento_id, sum(debe) AS d, sum(haber) AS h, count(*) AS n FROM apunte GROUP BY 1) t ON t.asiento_id = s.id
WHERE s.ejercicio = {YEAR} AND s.id IN (SELECT asiento_id FROM apunte WHERE starts_with(cuenta, '3'))""")
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.journal(asiento(spark, sf_dir), apunte(spark, sf_dir), F.col("ejercicio") == YEAR, F.col("cuenta").startswith("3"))
    return found.select("id", "fecha", "estado", "total_debe", "total_haber", "n_apuntes")


@register("q06_entry_search", _JOINED + """ SELECT asiento_id, orden, cuenta, debe, haber FROM lineas
WHERE debe + haber BETWEEN 29700.00 AND 30300.00 AND debe > 0 AND upper(concepto) LIKE '%FRA A%' AND starts_with(cuenta, '2') AND hoja IS NULL""")
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("debe") + F.col("haber")
    found = _lines(spark, sf_dir).where(
        predicates.near_amount(Decimal("30000.00"), amount) & predicates.on_side("debe", F.col("debe"), F.col("haber"))
        & predicates.holds_text("fra a", F.col("concepto")) & predicates.account_matches("2", F.col("cuenta"), F.col("cuenta")) & F.col("hoja").isNull()
    )
    return found.select("asiento_id", "orden", "cuenta", "debe", "haber")


@register("q07_year_comparison", _JOINED + f""", s AS (
  SELECT left(cuenta, 3) AS codigo, ejercicio, sum(debe - haber) AS saldo FROM lineas
  WHERE estado = 'contabilizado' AND tipo <> 'cierre' AND ejercicio IN ({YEAR}, {YEAR - 1}) GROUP BY 1, 2),
p AS (SELECT codigo, coalesce(sum(saldo) FILTER (ejercicio = {YEAR}), 0) AS a, coalesce(sum(saldo) FILTER (ejercicio = {YEAR - 1}), 0) AS b FROM s GROUP BY 1)
SELECT codigo, CAST(a AS DECIMAL(24,2)) AS actual, CAST(b AS DECIMAL(24,2)) AS anterior, CAST(a - b AS DECIMAL(24,2)) AS variacion,
  CASE WHEN b <> 0 THEN CAST(round_even(CAST((a - b) * 100 AS DOUBLE) / CAST(abs(b) AS DOUBLE), 1) AS DECIMAL(20,1)) END AS porcentaje FROM p WHERE a <> 0 OR b <> 0""")
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    now, before = (ledger.balance_of(ledger.period_trial_balance(lines, y, f"{y}-01-01", f"{y}-12-31", level=3)) for y in (YEAR, YEAR - 1))
    return ledger.year_comparison(now, before)


@register("q10_account_balance", _BASE + f"""
SELECT CAST(coalesce(sum(CASE WHEN fecha < DATE '{FIRST}' THEN debe - haber END), 0) AS DECIMAL(24,2)) AS inicial,
  CAST(coalesce(sum(CASE WHEN fecha >= DATE '{FIRST}' THEN debe END), 0) AS DECIMAL(24,2)) AS debe,
  CAST(coalesce(sum(CASE WHEN fecha >= DATE '{FIRST}' THEN haber END), 0) AS DECIMAL(24,2)) AS haber,
  CAST(coalesce(sum(debe - haber), 0) AS DECIMAL(24,2)) AS final, count(CASE WHEN fecha >= DATE '{FIRST}' THEN 1 END) AS movimientos
FROM base WHERE estado = 'contabilizado' AND starts_with(cuenta, '5') AND fecha <= DATE '{LAST}'""")
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.account_balance(_lines(spark, sf_dir), YEAR, "5", FIRST, LAST)


@register("q14_entry_impact", _JOINED + """, propio AS (
  SELECT cuenta, ejercicio, fecha, numero, sum(debe - haber) AS p FROM lineas WHERE asiento_id = (SELECT max(asiento_id) FROM apunte) GROUP BY ALL)
SELECT p.cuenta, CAST(coalesce(sum(l.debe - l.haber), 0) AS DECIMAL(24,2)) AS antes, CAST(coalesce(sum(l.debe - l.haber), 0) + any_value(p.p) AS DECIMAL(24,2)) AS despues
FROM propio p LEFT JOIN lineas l ON l.cuenta = p.cuenta AND l.ejercicio = p.ejercicio AND l.estado <> 'anulado' AND (l.fecha, l.numero) < (p.fecha, p.numero) GROUP BY p.cuenta""")
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    last = apunte(spark, sf_dir).agg(F.max("asiento_id")).first()[0]
    return ledger.entry_impact(lines, last)


@register("w06_renumber", f"""WITH {ASIENTO} SELECT id, ejercicio, row_number() OVER (PARTITION BY ejercicio ORDER BY
  CASE tipo WHEN 'apertura' THEN 0 WHEN 'regularizacion' THEN 2 WHEN 'cierre' THEN 3 ELSE 1 END, fecha, id) AS nuevo_numero FROM asiento""")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.renumber(asiento(spark, sf_dir)).select("id", "ejercicio", "nuevo_numero")


@register("w07_renumber_lines", f"""WITH {APUNTE} SELECT asiento_id, cuenta, debe, haber,
  row_number() OVER (PARTITION BY asiento_id ORDER BY haber > 0, orden, cuenta, debe, haber) AS nuevo_orden FROM apunte""")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.renumber_lines(apunte(spark, sf_dir), "cuenta", "debe", "haber").select("asiento_id", "cuenta", "debe", "haber", "nuevo_orden")


@register("w10_number_gaps", f"""WITH {ASIENTO}, n AS (SELECT DISTINCT ejercicio, numero AS n FROM asiento),
g AS (SELECT ejercicio, n, coalesce(lag(n) OVER (PARTITION BY ejercicio ORDER BY n), 0) AS previo FROM n)
SELECT ejercicio, previo + 1 AS desde, n - 1 AS hasta FROM g WHERE n - previo > 1""")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.number_gaps(asiento(spark, sf_dir), "ejercicio", "numero")


@register("w11_next_free_code", f"""WITH {APUNTE} SELECT '4' || lpad(CAST(max(CAST(substr(cuenta, 2) AS BIGINT)) + 1 AS VARCHAR), 7, '0') AS codigo FROM apunte WHERE starts_with(cuenta, '4')""")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.next_free_code(cuenta(spark, sf_dir), "4")


@register("a09_non_zero_balances", _JOINED + " SELECT cuenta, CAST(sum(debe - haber) AS DECIMAL(24,2)) AS saldo FROM lineas WHERE estado = 'contabilizado' GROUP BY 1 HAVING sum(debe) <> sum(haber)")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.non_zero_balances(_lines(spark, sf_dir), F.col("estado") == "contabilizado")


@register("q36_closing_entry", _JOINED + f""", s AS (SELECT cuenta, sum(debe - haber) AS s FROM lineas
  WHERE estado = 'contabilizado' AND ejercicio = {YEAR} AND left(cuenta, 1) IN ('6', '7') GROUP BY 1 HAVING sum(debe - haber) <> 0)
SELECT cuenta, CAST(greatest(-s, 0) AS DECIMAL(24,2)) AS debe, CAST(greatest(s, 0) AS DECIMAL(24,2)) AS haber FROM s
UNION ALL SELECT '12900000', CAST(greatest(t, 0) AS DECIMAL(24,2)), CAST(greatest(-t, 0) AS DECIMAL(24,2)) FROM (SELECT sum(s) AS t FROM s) WHERE t <> 0""")
def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ledger.posted_lines(_lines(spark, sf_dir), YEAR)
    return ledger.closing_lines(ledger.non_zero_balances(lines, predicates.any_prefix(F.col("cuenta"), ["6", "7"])), "12900000")


@register("d02_reversal", f"WITH {APUNTE} SELECT asiento_id, orden, cuenta, haber AS debe, debe AS haber FROM apunte")
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.swap_sides(apunte(spark, sf_dir).select("asiento_id", "orden", "cuenta", "debe", "haber"))


@register("d05_unique_counterpart", f"""WITH {APUNTE}, lado AS (SELECT asiento_id, debe > 0 AS al_debe, count(*) AS n, min(cuenta) AS sola FROM apunte GROUP BY ALL)
SELECT a.asiento_id, a.orden, a.cuenta, l.sola AS contrapartida_asignada FROM apunte a LEFT JOIN lado l ON l.asiento_id = a.asiento_id AND l.al_debe = NOT (a.debe > 0) AND l.n = 1""")
def d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.unique_counterpart(apunte(spark, sf_dir)).select("asiento_id", "orden", "cuenta", "contrapartida_asignada")


@register("j21_possible_duplicates", f"""{LEDGER}, t AS (SELECT asiento_id, sum(debe) AS total, list_sort(list_distinct(list(cuenta))) AS cuentas FROM apunte GROUP BY 1),
h AS (SELECT s.*, t.total, t.cuentas FROM asiento s JOIN t ON t.asiento_id = s.id WHERE s.estado <> 'anulado')
SELECT DISTINCT a.id, b.id AS id_2 FROM h a JOIN h b ON a.id < b.id AND a.total = b.total
  AND ((a.ejercicio = b.ejercicio AND upper(a.numero_externo) = upper(b.numero_externo) AND a.numero_externo <> '') OR (a.fecha = b.fecha AND a.concepto = b.concepto AND a.cuentas = b.cuentas))""")
def j21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.possible_duplicates(asiento(spark, sf_dir), apunte(spark, sf_dir))


@register("a14_count_by_state", f"WITH {ASIENTO} SELECT estado, count(*) AS n FROM asiento GROUP BY 1")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asiento(spark, sf_dir).groupBy("estado").agg(F.count("*").alias("n"))


@register("a15_conditional_counts", f"""WITH {ASIENTO} SELECT count(*) AS total, count(CASE WHEN estado = 'borrador' THEN 1 END) AS borradores,
  count(CASE WHEN hoja IS NULL THEN 1 END) AS sin_hoja, count(CASE WHEN estado = 'contabilizado' AND tipo = 'operacion' THEN 1 END) AS operaciones FROM asiento""")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asiento(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_if(F.col("estado") == "borrador").alias("borradores"), F.count_if(F.col("hoja").isNull()).alias("sin_hoja"),
        F.count_if((F.col("estado") == "contabilizado") & (F.col("tipo") == "operacion")).alias("operaciones"),
    )


@register("a17_year_overview", f"WITH {ASIENTO} SELECT ejercicio, count(*) AS asientos, max(numero) AS ultimo, max(fecha) AS ultima_fecha FROM asiento GROUP BY 1")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asiento(spark, sf_dir).groupBy("ejercicio").agg(F.count("*").alias("asientos"), F.max("numero").alias("ultimo"), F.max("fecha").alias("ultima_fecha"))


@register("a52_entry_class", f"""WITH {APUNTE} SELECT CASE WHEN n = 2 THEN 'simple' WHEN n > 2 THEN 'compuesto' ELSE 'incompleto' END AS clase, count(*) AS asientos
FROM (SELECT asiento_id, count(*) AS n FROM apunte GROUP BY 1) GROUP BY 1""")
def a52(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = apunte(spark, sf_dir).groupBy("asiento_id").agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") == 2, "simple").when(F.col("n") > 2, "compuesto").otherwise("incompleto").alias("clase")).agg(F.count("*").alias("asientos"))


@register("a11_unbalanced_entries", f"""{LEDGER} SELECT s.id, CAST(coalesce(sum(a.debe), 0) AS DECIMAL(24,2)) AS debe, CAST(coalesce(sum(a.haber), 0) AS DECIMAL(24,2)) AS haber, count(a.asiento_id) AS n
FROM asiento s LEFT JOIN apunte a ON a.asiento_id = s.id WHERE s.ejercicio = {YEAR} AND s.estado = 'contabilizado' GROUP BY 1 HAVING count(a.asiento_id) < 2 OR coalesce(sum(a.debe), 0) <> coalesce(sum(a.haber), 0)""")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.unbalanced(asiento(spark, sf_dir), apunte(spark, sf_dir), YEAR)


@register("a12_three_totals", _JOINED + f""" SELECT 'asiento' AS vista, CAST(sum(d) AS DECIMAL(24,2)) AS debe, CAST(sum(h) AS DECIMAL(24,2)) AS haber FROM (SELECT asiento_id, sum(debe) AS d, sum(haber) AS h FROM lineas WHERE estado = 'contabilizado' AND ejercicio = {YEAR} GROUP BY 1)
UNION ALL SELECT 'cuenta', CAST(sum(d) AS DECIMAL(24,2)), CAST(sum(h) AS DECIMAL(24,2)) FROM (SELECT cuenta, sum(debe) AS d, sum(haber) AS h FROM lineas WHERE estado = 'contabilizado' AND ejercicio = {YEAR} GROUP BY 1)
UNION ALL SELECT 'saldos', CAST(coalesce(sum(CASE WHEN d > h THEN d - h END), 0) AS DECIMAL(24,2)), CAST(coalesce(sum(CASE WHEN h > d THEN h - d END), 0) AS DECIMAL(24,2)) FROM (SELECT cuenta, sum(debe) AS d, sum(haber) AS h FROM lineas WHERE estado = 'contabilizado' AND ejercicio = {YEAR} GROUP BY 1)""")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.three_totals(ledger.posted_lines(_lines(spark, sf_dir), YEAR))


@register("j18_double_corrections", f"WITH {ASIENTO} SELECT a.id, a.revierte FROM asiento a JOIN asiento b ON b.id = a.revierte WHERE b.estado = 'anulado' AND a.estado <> 'anulado'")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.double_corrections(asiento(spark, sf_dir))


@register("j19_not_yet_reversed", f"WITH {ASIENTO} SELECT id FROM asiento WHERE estado = 'contabilizado' AND id NOT IN (SELECT revierte FROM asiento WHERE revierte IS NOT NULL AND estado <> 'anulado')")
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = asiento(spark, sf_dir)
    done = heads.where(F.col("revierte").isNotNull() & (F.col("estado") != "anulado")).select(F.col("revierte").alias("id"))
    return heads.where(F.col("estado") == "contabilizado").join(done, "id", "left_anti").select("id")


@register("o02_mixed_sort_page", f"WITH {ASIENTO} SELECT id, fecha, numero FROM asiento ORDER BY fecha DESC NULLS FIRST, numero DESC, id LIMIT 50 OFFSET 100")
def o02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asiento(spark, sf_dir).orderBy(F.desc_nulls_first("fecha"), F.desc("numero"), "id").offset(100).limit(50).select("id", "fecha", "numero")


@register("o07_last_movements", f"""WITH {APUNTE}, r AS (SELECT *, row_number() OVER (PARTITION BY cuenta ORDER BY asiento_id DESC, orden DESC, debe DESC, haber DESC, punteo DESC) AS k FROM apunte)
SELECT cuenta, asiento_id, orden, debe, haber FROM r WHERE k <= 3""")
def o07(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = Window.partitionBy("cuenta").orderBy(*(F.desc(c) for c in ("asiento_id", "orden", "debe", "haber", "punteo")))
    return apunte(spark, sf_dir).withColumn("k", F.row_number().over(last)).where("k <= 3").select("cuenta", "asiento_id", "orden", "debe", "haber")
