"""Entry templates (survey Q36, Q37): each turns a row of data into lines (cuenta, debe, haber), as a Column of structs.

Shares are rounded half up; what rounding leaves goes to the balancing line; lines without an amount are
dropped. ``lines`` unnests the result.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posada.functions.numbers import percentage_of, vat_split

# Rates that the forms offer.
VAT_OPTIONS, WITHHOLDING_OPTIONS = (21, 10, 4, 0), (0, 15, 7, 19)


def _line(account: Column | str, debe: Column | None = None, haber: Column | None = None) -> Column:
    zero = F.lit(Decimal("0.00"))
    amount = lambda c: (zero if c is None else F.coalesce(c, zero)).cast("decimal(14,2)")
    return F.struct((F.lit(account) if isinstance(account, str) else account).alias("cuenta"), amount(debe).alias("debe"), amount(haber).alias("haber"))


def _kept(*lines: Column) -> Column:
    return F.array_compact(F.array(*(F.when((x["debe"] != 0) | (x["haber"] != 0), x) for x in lines)))


def cash_sale() -> Column:
    """Gross total, VAT rate; money account, income account."""
    s = vat_split(F.col("total"), F.col("iva"))
    return _kept(_line(F.col("tesoreria"), debe=F.col("total")), _line(F.col("ingreso"), haber=s["base"]), _line("47700000", haber=s["quota"]))


def credit_sale() -> Column:
    """Base and VAT rate on a customer's account."""
    q = percentage_of(F.col("base"), F.col("iva"))
    return _kept(_line(F.col("cliente"), debe=F.col("base") + q), _line(F.col("ingreso"), haber=F.col("base")), _line("47700000", haber=q))


def purchase() -> Column:
    """Base, VAT and withholding on a supplier's account."""
    q, w = percentage_of(F.col("base"), F.col("iva")), percentage_of(F.col("base"), F.col("retencion"))
    return _kept(_line(F.col("gasto"), debe=F.col("base")), _line("47200000", debe=q), _line("47510000", haber=w), _line(F.col("proveedor"), haber=F.col("base") + q - w))


def payment() -> Column:
    return _kept(_line(F.col("proveedor"), debe=F.col("importe")), _line(F.col("tesoreria"), haber=F.col("importe")))


def collection() -> Column:
    return _kept(_line(F.col("tesoreria"), debe=F.col("importe")), _line(F.col("cliente"), haber=F.col("importe")))


def transfer() -> Column:
    return _kept(_line(F.col("destino"), debe=F.col("importe")), _line(F.col("origen"), haber=F.col("importe")))


def payroll_entry() -> Column:
    """Gross pay, company contributions, withheld tax and the employee's share; net pay is what remains."""
    net = F.col("bruto") - F.col("irpf") - F.col("ss_trabajador")
    return _kept(
        _line("64000000", debe=F.col("bruto")), _line("64200000", debe=F.col("ss_empresa")), _line("47510000", haber=F.col("irpf")),
        _line("47600000", haber=F.col("ss_empresa") + F.col("ss_trabajador")), _line("46500000", haber=net),
    )


def depreciation() -> Column:
    return _kept(_line("68100000", debe=F.col("importe")), _line(F.col("amortizacion"), haber=F.col("importe")))


def vat_settlement() -> Column:
    """Charged and borne VAT against each other; the rest is payable or receivable."""
    rest = F.col("repercutido") - F.col("soportado")
    zero = F.lit(Decimal("0.00"))
    return _kept(
        _line("47700000", debe=F.col("repercutido")), _line("47200000", haber=F.col("soportado")),
        _line("47500000", haber=F.greatest(rest, zero)), _line("47000000", debe=F.greatest(-rest, zero)),
    )


TEMPLATES: dict[str, Callable[[], Column]] = {
    "venta_contado": cash_sale, "venta_credito": credit_sale, "compra": purchase, "pago": payment, "cobro": collection, "traspaso": transfer,
    "nomina": payroll_entry, "amortizacion": depreciation, "liquidacion_iva": vat_settlement,
}


def lines(data: DataFrame, template: str, key: str) -> DataFrame:
    """The lines of each row's entry, numbered from 1."""
    return data.select(key, F.posexplode(TEMPLATES[template]()).alias("k", "x")).select(key, (F.col("k") + 1).cast("long").alias("orden"), "x.cuenta", "x.debe", "x.haber")
