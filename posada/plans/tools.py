"""A typed registry of queries and charts (survey UD01, UD07-UD09, Q24-Q28).

A tool is a function from a context of tables and checked arguments to a DataFrame. ``run`` never raises:
it returns an envelope whose status tells what went wrong, and rows are read only as far as asked.
"""

from __future__ import annotations

import datetime as dt
import inspect
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posada.operators import archive, cash, integrity, ledger, profit, statements
from posada.operators.predicates import account_matches

Tables = Mapping[str, DataFrame]
KINDS = {int: "integer", str: "string", bool: "boolean", dt.date: "date"}


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    function: Callable[..., DataFrame]
    permissions: frozenset[str]

    @property
    def arguments(self) -> dict[str, inspect.Parameter]:
        return dict(list(inspect.signature(self.function, eval_str=True).parameters.items())[1:])

    def schema(self) -> dict[str, Any]:
        """The arguments as a JSON schema."""
        shown = {n: {"type": KINDS[p.annotation]} | ({} if p.default is p.empty else {"default": p.default}) for n, p in self.arguments.items()}
        return {"name": self.name, "description": self.about, "parameters": {"type": "object", "properties": shown, "required": [n for n, p in self.arguments.items() if p.default is p.empty]}}

    def check(self, given: Mapping[str, Any]) -> dict[str, Any]:
        """Arguments of the declared kinds; raises ValueError naming what is wrong."""
        known = self.arguments
        if unknown := sorted(set(given) - set(known)):
            raise ValueError(f"unknown arguments: {', '.join(unknown)}")
        out = {}
        for name, p in known.items():
            if name not in given:
                if p.default is p.empty:
                    raise ValueError(f"{name} is missing")
                continue
            value = given[name]
            if p.annotation is dt.date and isinstance(value, str):
                value = dt.date.fromisoformat(value)
            if not isinstance(value, p.annotation) or (p.annotation is int and isinstance(value, bool)):
                raise ValueError(f"{name} must be of type {KINDS[p.annotation]}")
            out[name] = value
        return out


@dataclass
class Result:
    status: str  # ok, empty, unknown_tool, forbidden, invalid, error
    rows: list[dict[str, Any]] = field(default_factory=list)
    total: int = 0
    columns: list[str] = field(default_factory=list)
    message: str = ""
    ms: int = 0


TOOLS: dict[str, Tool] = {}


def tool(*permissions: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TOOLS[f.__name__] = Tool(f.__name__, (f.__doc__ or "").strip(), f, frozenset(permissions))
        return f

    return add


def available(permissions: frozenset[str]) -> list[dict[str, Any]]:
    return [t.schema() for t in TOOLS.values() if t.permissions <= permissions]


def run(name: str, given: Mapping[str, Any], tables: Tables, permissions: frozenset[str], limit: int = 50) -> Result:
    """At most ``limit`` rows, with the number there are."""
    began = time.monotonic()
    found = TOOLS.get(name)
    if found is None:
        return Result("unknown_tool", message=name)
    if not found.permissions <= permissions:
        return Result("forbidden", message=", ".join(sorted(found.permissions - permissions)))
    try:
        arguments = found.check(given)
    except ValueError as e:
        return Result("invalid", message=str(e))
    try:
        df = found.function(tables, **arguments)
        rows = [r.asDict(recursive=True) for r in df.limit(limit).collect()]
        total = len(rows) if len(rows) < limit else df.count()
    except Exception as e:  # the envelope is the contract: a tool never raises
        return Result("error", message=f"{type(e).__name__}: {e}"[:500])
    return Result("ok" if rows else "empty", rows, total, df.columns, ms=int(1000 * (time.monotonic() - began)))


def _lines(t: Tables) -> DataFrame:
    return ledger.with_headers(t["apunte"], t["asiento"])


@tool("contabilidad")
def buscar_cuentas(t: Tables, texto: str) -> DataFrame:
    """Accounts whose code begins with the digits given, or whose name holds the text."""
    return t["cuenta"].where(account_matches(texto, F.col("codigo"), F.col("nombre"))).orderBy("codigo")


@tool("contabilidad")
def saldo_cuenta(t: Tables, ejercicio: int, cuenta: str, desde: dt.date, hasta: dt.date) -> DataFrame:
    """Opening, movements and final balance of an account or group."""
    return ledger.account_balance(_lines(t), ejercicio, cuenta, desde.isoformat(), hasta.isoformat())


@tool("contabilidad")
def balance_sumas_saldos(t: Tables, ejercicio: int, desde: dt.date, hasta: dt.date, nivel: int = 3) -> DataFrame:
    """Trial balance of a period at a level."""
    return ledger.period_trial_balance(_lines(t), ejercicio, desde.isoformat(), hasta.isoformat(), nivel).orderBy("codigo")


@tool("contabilidad")
def extracto_cuenta(t: Tables, ejercicio: int, cuenta: str, ultimos: int = 50) -> DataFrame:
    """The last movements of an account with their running balance, in order."""
    rows = ledger.extract(_lines(t), ejercicio, cuenta, only_posted=True)
    last = rows.orderBy(F.desc("fecha"), F.desc("numero"), F.desc("orden")).limit(ultimos)
    return last.orderBy("fecha", "numero", "orden")


@tool("contabilidad")
def diario_asientos(t: Tables, ejercicio: int, cuenta: str = "") -> DataFrame:
    """Entries of a year, those with a line on the account if one is given."""
    line = F.col("cuenta").startswith(cuenta) if cuenta else None
    return ledger.journal(t["asiento"], t["apunte"], F.col("ejercicio") == ejercicio, line).orderBy("fecha", "numero")


@tool("cajas")
def resumen_cajas(t: Tables, anio: int) -> DataFrame:
    """Cash sums by month."""
    return cash.month_sums(t["caja_dia"], anio).orderBy("mes")


@tool("nominas")
def coste_personal(t: Tables, anio: int) -> DataFrame:
    """Payroll cost and employees by department."""
    return cash.payroll_by_department(t["nomina_mensual"], anio).orderBy(F.desc("coste"))


@tool("contabilidad")
def comprobacion_contable(t: Tables, ejercicio: int) -> DataFrame:
    """The integrity controls of a year with their state."""
    return integrity.report(t["asiento"], t["apunte"], t["cuenta"], ejercicio, f"{ejercicio}-01-01", f"{ejercicio}-12-31").orderBy("control")


@tool("contabilidad")
def cuentas_anuales(t: Tables, ejercicio: int, estado: str = "pyg") -> DataFrame:
    """A statement of a year beside the year before, by the model among the tables, or the abridged profit and loss account."""
    lines = _lines(t)
    model = t["modelo"].where(F.col("estado") == estado).drop("estado") if "modelo" in t else statements.abridged_profit_and_loss(lines.sparkSession)
    groups = ("6", "7") if estado == "pyg" else ("1", "2", "3", "4", "5")
    return statements.statement(statements.year_balances(lines, estado, (ejercicio, ejercicio - 1)), model, groups).orderBy("orden")


@tool("beneficio")
def resumen_beneficio(t: Tables, mes: int = 0) -> DataFrame:
    """The profit summary's months, or one of them."""
    rows = t["resumen"] if not mes else t["resumen"].where(F.col("mes") == mes)
    return rows.select("mes", "ingresos", "gastos", "beneficio", "acumulado").orderBy("mes")


@tool("facturas")
def buscar_facturas(t: Tables, proveedor: str = "", numero: str = "", desde: dt.date = None, hasta: dt.date = None) -> DataFrame:
    """Received invoices of the stores at hand by supplier, number or dates; one of them must be given."""
    stores = {n: t[n] for n in ("facturas_ia", "gestion_facturas") if n in t}
    companies = [r["empresa_id"] for r in t["empresas"].select("empresa_id").collect()] if "empresas" in t else []  # those that the caller may see
    found = archive.search(stores, companies, proveedor, numero, desde and desde.isoformat(), hasta and hasta.isoformat())
    return found.orderBy(F.desc("fecha"), "origen", "referencia")


@tool("facturas")
def estado_entrenamiento_facturas(t: Tables) -> DataFrame:
    """How many documents are ready to teach, and why the others aren't."""
    return archive.training_readiness(t["documentos"])


# ------------------------------------------------------------------ charts

MAX_SERIES = 12


@dataclass(frozen=True)
class Chart:
    """A chart's data as (mes, serie, valor), or (categoria, serie, valor) where ``monthly`` is False."""

    name: str
    data: Callable[..., DataFrame]
    default_series: tuple[str, ...] = ()
    monthly: bool = True


def account_by_month(t: Tables, anio: int, cuenta: str) -> DataFrame:
    """The balance at the end of each of twelve months."""
    from pyspark.sql import Window

    lines = ledger.posted_lines(_lines(t), anio).where((F.col("tipo") != "cierre") & F.col("cuenta").startswith(cuenta))
    sums = lines.groupBy(F.month("fecha").cast("long").alias("mes")).agg(F.sum(F.col("debe") - F.col("haber")).alias("v"))
    months = lines.sparkSession.range(1, 13).select(F.col("id").alias("mes")).join(sums, "mes", "left")
    running = Window.orderBy("mes").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # twelve rows
    return months.select("mes", F.lit(f"Cuenta {cuenta}").alias("serie"), F.coalesce(F.sum("v").over(running), F.lit(0)).cast("decimal(24,2)").alias("valor"))


def profit_and_loss_by_month(t: Tables, anio: int) -> DataFrame:
    """Groups 7 and 6 and their difference by month."""
    lines = ledger.posted_lines(_lines(t), anio).where(~F.col("tipo").isin("regularizacion", "cierre") & F.left("cuenta", F.lit(1)).isin("6", "7"))
    net = F.col("haber") - F.col("debe")
    income = F.left("cuenta", F.lit(1)) == "7"
    sums = lines.groupBy(F.month("fecha").cast("long").alias("mes")).agg(
        F.coalesce(F.sum(F.when(income, net)), F.lit(0)).alias("Ingresos"), F.coalesce(F.sum(F.when(~income, -net)), F.lit(0)).alias("Gastos")
    )
    return profit.long_series(sums.withColumn("Resultado", F.col("Ingresos") - F.col("Gastos")), "Ingresos", "Gastos", "Resultado")


CHARTS = {
    c.name: c
    for c in (
        Chart("beneficio_mensual", lambda t, anio: profit.long_series(t["resumen"], "ingresos", "gastos", "beneficio", "acumulado"), ("ingresos", "gastos", "beneficio")),
        Chart("gastos_mensuales", lambda t, anio: profit.long_series(t["resumen"], "proveedores", "acreedores", "coste_nomina")),
        Chart("ingresos_mensuales", lambda t, anio: profit.long_series(t["resumen"], *profit.INCOME)),
        Chart("gastos_por_departamento", lambda t, anio: t["departamentos"].select(F.col("nombre").alias("categoria"), F.lit("total").alias("serie"), F.col("total").alias("valor")), monthly=False),
        Chart("gastos_por_categoria", lambda t, anio: t["categorias"].select(F.col("nombre").alias("categoria"), F.lit("total").alias("serie"), F.col("total").alias("valor")), monthly=False),
        Chart("ventas_cajas_mensuales", lambda t, anio: profit.long_series(cash.month_sums(t["caja_dia"], anio), *cash.AMOUNTS), ("bar", "comedor", "chill_out")),
        Chart("coste_personal_mensual", lambda t, anio: t["nomina_mensual"].where(F.col("anio") == anio).groupBy(F.col("mes").cast("long").alias("mes"), F.col("departamento").alias("serie")).agg(F.sum(F.col("cost_tot") + F.col("importe_extra")).cast("decimal(24,2)").alias("valor"))),
        Chart("saldo_cuenta_mensual", account_by_month),
        Chart("resultado_contable_mensual", profit_and_loss_by_month, ("Ingresos", "Gastos")),
    )
}


def build_chart(name: str, tables: Tables, anio: int, series: tuple[str, ...] = (), compare_with: tuple[int, ...] = (), first: int = 1, last: int = 12, pie: bool = False, **options: Any) -> DataFrame:
    """Q27: a chart's rows: chosen series, other years beside them, months trimmed; a pie sums the series of each category."""
    chart = CHARTS[name]
    if first > last or (chart.monthly and pie) or (not chart.monthly and compare_with):
        raise ValueError("these options don't go with this chart")
    wanted, parts = series or chart.default_series, None
    for y in (anio, *(y for y in compare_with if y != anio)):
        rows = chart.data(tables, y, **options)
        rows = rows.where(F.col("serie").isin(*wanted)) if wanted else rows
        if compare_with:
            rows = rows.withColumn("serie", F.concat_ws(" ", "serie", F.lit(str(y))))
        parts = rows if parts is None else parts.unionByName(rows)
    if chart.monthly:
        parts = parts.where(F.col("mes").between(first, last))
    if pie:
        parts = parts.groupBy("categoria").agg(F.sum("valor").alias("valor")).withColumn("serie", F.lit("Total"))
    return parts
