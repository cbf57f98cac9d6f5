"""Schemas of the engine's tables, and their keys as audits (survey section 1.3). Spark enforces no keys, so they are checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "cuenta": "codigo string, nombre string, nif string, definicion string, ubicacion string, padre string, imputable boolean, activa boolean, naturaleza string",
    "ejercicio": "anio int, fecha_inicio date, fecha_fin date, cerrado boolean, trabajadores_medios decimal(7,2), fecha_formulacion date",
    "asiento": "id long, ejercicio int, numero int, hoja string, fecha date, tipo string, titulo string, concepto string, numero_externo string, tipo_documento string, fecha_documento date, origen string, modelo string, referencia_origen string, estado string, creado timestamp, contabilizado_en timestamp, anulado_en timestamp, motivo_anulacion string, revierte long, rectifica long",
    "apunte": "id long, asiento_id long, orden short, cuenta string, contrapartida string, concepto string, debe decimal(14,2), haber decimal(14,2), punteo string, punteo_nota string, punteado_en timestamp",
    "reserva": "numero int, fecha_reserva date, agencia_codigo string, agencia string, tarifa string, no_reembolsable boolean, ref_agencia string, estado string, grupo string, entrada date, salida date, habitaciones short, adultos short, ninos short, cunas short, deposito decimal(12,2), fact_estancias decimal(12,2), fact_extras decimal(12,2), fact_impuesto decimal(12,2), fact_total decimal(12,2), pend_estancias decimal(12,2), pend_extras decimal(12,2), pend_tasas decimal(12,2), pend_total decimal(12,2), total_estancias decimal(12,2), facturas string",
    "compra_proveedor": "tipo string, numero string, fecha date, codigo_proveedor int, proveedor string, nif string, bruto decimal(12,2), dto_pp decimal(12,2), portes_gastos decimal(12,2), iva decimal(12,2), irpf decimal(12,2), total decimal(12,2)",
    "factura_acreedor": "fichero string, acreedor string, fecha date, documento string, cuenta string, importe decimal(12,2), asiento int, linea int",
    "apunte_iva": "libro string, fecha date, documento string, concepto string, cuenta string, cuota decimal(12,2), asiento int, linea int",
    "extra_personal": "anio short, mes short, persona string, importe decimal(12,2)",
    "gasto_adicional": "id long, concepto string, acreedor string, cuenta string, base decimal(12,2), iva decimal(12,2), desde date, hasta date, departamento string, asiento_iva int",
    "departamento_albaran": "tipo string, numero string, codigo_proveedor int, fecha date, proveedor string, total decimal(12,2), departamento string",
    "asignacion_departamento": "origen string, clave string, nombre string, departamento string",
    "tercero": "cuenta string, nombre string, nif string, tipo string, categoria string, departamentos string",
    "caja_dia": "anio short, mes short, dia short, bar decimal(12,2), comedor decimal(12,2), chill_out decimal(12,2), ecotasa decimal(12,2), menus decimal(12,2), facturas decimal(12,2), parking_efectivo decimal(12,2), parking_visa decimal(12,2)",
    "nomina_mensual": "nif string, anio int, mes int, departamento string, deveng decimal(10,2), irpf_esp decimal(10,2), irpf_din decimal(10,2), s_neto decimal(10,2), ss_trabaj decimal(10,2), ss_empr decimal(10,2), cost_tot decimal(10,2), importe_extra decimal(10,2)",
}

KEYS = {
    "cuenta": ("codigo",), "ejercicio": ("anio",), "asiento": ("ejercicio", "numero"), "apunte": ("id",), "reserva": ("numero",), "extra_personal": ("anio", "mes", "persona"),
    "departamento_albaran": ("tipo", "numero", "codigo_proveedor"), "asignacion_departamento": ("origen", "clave"), "tercero": ("cuenta",), "caja_dia": ("anio", "mes", "dia"),
    "nomina_mensual": ("nif", "anio", "mes"),
}


def audit(name: str, df: DataFrame) -> DataFrame:
    """Keys of a table that stand more than once, as (tabla, clave, n)."""
    keys = KEYS[name]
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("tabla"), F.concat_ws("|", *keys).alias("clave"), "n")
