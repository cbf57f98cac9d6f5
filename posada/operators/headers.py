"""Invoice headers from positioned cells, and the supplier's name from text (survey F20, F21).

A label is paired with the nearest cell below it or to its right whose text has the field's type. Where cells are rows, they and the windows of labels
meet in tiles of a page, so that a page with any number of cells makes no pairs but those of neighbours. Where a row holds a whole page, its cells are
paired there and nothing but the values found is dealt out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posada.functions.text import name_key
from posada.operators.extraction import COMPANY_ID, DATE, PERSON_ID

# Labels of a number and of a date, the words before a number, how far (in points) a value may lie from its label, and by how much a value below must overlap.
NUMBER_LABEL = r"(?iU)^(?:(?:N[ÚU]M(?:ERO)?|N[ºO°?])\.?\s*(?:DE\s+)?)?FACTURA(?:\s*(?:N[ÚU]M(?:ERO)?|N[ºO°?])\.?)?\s*:?$|^N[ÚU]MERO\s*:?$|^N[ºO°?]\.?\s*:?$|^INVOICE(?:\s*N[OU]\.?)?\s*:?$"
DATE_LABEL = r"(?iU)^FECHA(?:\s+(?:DE\s+)?(?:FACTURA|EMISI[ÓO]N|EXPEDICI[ÓO]N))?\s*:?$|^DATE\s*:?$"
NUMBER_PREFIX = r"(?iU)^(?:factura\s*)?(?:n[úu]m(?:ero)?|n[ºo°?])\.?\s*[:.]?\s*"
BELOW, RIGHT, SAME_ROW, OVERLAP, SLACK = 32.0, 120.0, 4.0, 0.3, 1.0

# Company names are one to six words and a legal form on one line; words that may stand before a name and aren't part of it.
NAME_WORD = r"[A-ZÁÉÍÓÚÑÜ][A-Za-zÁÉÍÓÚÑÜáéíóúñü&'’\-]*\d{0,2}(?![A-Za-z0-9ÁÉÍÓÚÑÜáéíóúñü&'’\-])"
NAME_LINK = r"(?:DE|DEL|LA|LAS|LOS|EL|Y|E|I|de|del|la|las|los|el|y|e|i)"
LEGAL_FORM = r"(?:S\.\s?L\.\s?U\.|S\.\s?L\.|SLU|SL|S\.\s?A\.\s?U\.|S\.\s?A\.|SAU|SA|S\.\s?COOP\.?|S\.\s?C\.|C\.\s?B\.|CB|SC)"
COMPANY = re.compile(rf"({NAME_WORD}(?:[ \t]+(?:{NAME_LINK}[ \t]+)?{NAME_WORD}){{0,5}}?),?[ \t]+({LEGAL_FORM})(?![\wÁÉÍÓÚÑ])")
NOT_A_NAME = ("FACTURA", "ALBARAN", "PRESUPUESTO", "PEDIDO", "CLIENTE", "PROVEEDOR", "DATOS", "EMISOR", "RECEPTOR", "NIF", "CIF", "RAZON", "SOCIAL", "DUPLICADO", "COPIA", "ORIGINAL")

TILE_X, TILE_Y = 128.0, 48.0
CELL = ("left", "bottom", "right", "top")
MARKS = "document_id long, kind string, offset long, text string, form string, line string"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def without_prefix(text: Column) -> Column:
    return F.regexp_replace(text, NUMBER_PREFIX, "")


def is_number(text: Column) -> Column:
    other = rf"^(?:{DATE}|\d+[.,]\d{{2}}|[A-HJ-NP-SUVW][- ]?\d{{7}}[0-9A-J])$"
    return F.length(text).between(2, 25) & ~text.rlike(other)


def is_date(text: Column) -> Column:
    return text.rlike(rf"^{DATE}$")


def invoice_number(c: Column) -> Column:
    """The text without a word for "number" if it may be an invoice's number, else null: 2 to 25 characters with a digit, and no date, amount, tax id or label."""
    # neither labels nor the words before a number hold a digit, so a text without one needs no other pattern
    text = without_prefix(stripped(c))
    return F.when(c.rlike(r"\d"), F.when(is_number(text), text))


def invoice_date(c: Column) -> Column:
    """The text if it is one date and nothing else, else null."""
    return F.when(c.rlike(r"\d"), F.when(is_date(stripped(c)), stripped(c)))


FIELDS = {"numero": (NUMBER_LABEL, invoice_number), "fecha": (DATE_LABEL, invoice_date)}
# the same in two steps, for a page in one row: what is cut from a stripped text, if anything, and what the rest must be
CUTS = {"numero": (without_prefix, is_number), "fecha": (None, is_date)}


def _middle(at: Mapping[str, Column]) -> Column:
    return (at["top"] + at["bottom"]) / 2


def _reach(e: Mapping[str, Column], v: Mapping[str, Column]) -> tuple[Column, Column, Column, Column]:
    """From the places of a label and a value: is the value below it, and how far; else is it beside it, and how far."""
    drop, gap = e["bottom"] - v["top"], v["left"] - e["right"]
    shared = F.least(e["right"], v["right"]) - F.greatest(e["left"], v["left"])
    narrow = F.greatest(F.least(e["right"] - e["left"], v["right"] - v["left"]), F.lit(1.0))
    below = drop.between(-SLACK, BELOW) & (shared >= OVERLAP * narrow)
    beside = ~below & (F.abs(_middle(v) - _middle(e)) <= SAME_ROW) & gap.between(-SLACK, RIGHT)
    return below, drop, beside, gap


def _tiles(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def labelled_values(cells: DataFrame) -> DataFrame:
    """(document_id, page, campo, etiqueta, valor, distancia): each label's nearest value of its type; of equally near ones the first cell.

    Cells are (document_id, page, cell, left, bottom, right, top, text), ``cell`` being the order of print and unique in a document. Cells without a
    text or a place, and labels without a value near them, give no row.
    """
    def typed(name: str, of: Callable[[str, Callable], Column]) -> DataFrame:
        """A row for each cell and field where ``of`` isn't null; labels and values are told on their own, each by their own patterns."""
        found = F.explode(F.array(*(F.struct(F.lit(campo).alias("campo"), of(label, check).alias(name)) for campo, (label, check) in FIELDS.items())))
        return cells.select("document_id", "page", "cell", *(F.col(c).cast("double").alias(c) for c in CELL), found.alias("f")).select("document_id", "page", "cell", *CELL, "f.*").where(F.col(name).isNotNull())

    is_label = typed("es_etiqueta", lambda label, check: F.when(stripped(F.col("text")).rlike(label), True))
    labels = is_label.select("document_id", "page", "campo", F.col("cell").alias("etiqueta"), *(F.col(c).alias(f"l_{c}") for c in CELL))
    e, v = {c: F.col(f"l_{c}") for c in CELL}, {c: F.col(c) for c in CELL}
    box = lambda kind, x0, x1, y0, y1: F.struct(F.lit(kind).alias("kind"), x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    left, right, foot, mid = e["left"], e["right"], e["bottom"], _middle(e)
    windows = labels.withColumn("w", F.explode(F.array(box("below", left, right, foot - BELOW, foot + SLACK), box("right", right - SLACK, right + RIGHT, mid - SAME_ROW, mid + SAME_ROW))))
    windows = windows.withColumn("tx", F.explode(_tiles(F.col("w.x0"), F.col("w.x1"), TILE_X))).withColumn("ty", F.explode(_tiles(F.col("w.y0"), F.col("w.y1"), TILE_Y)))
    values = typed("valor", lambda label, check: check(F.col("text")))
    points = values.withColumn("v", F.explode(F.array(box("below", F.col("left"), F.col("right"), F.col("top"), F.col("top")), box("right", F.col("left"), F.col("left"), _middle(v), _middle(v)))))
    points = points.withColumn("tx", F.explode(_tiles(F.col("v.x0"), F.col("v.x1"), TILE_X))).withColumn("ty", F.floor(F.col("v.y0") / TILE_Y))
    w = windows.select("document_id", "page", "campo", F.col("w.kind").alias("kind"), "tx", "ty", "etiqueta", *e.values())
    v_ = points.select("document_id", "page", "campo", F.col("v.kind").alias("kind"), "tx", "ty", "cell", *v.values(), "valor", F.col("v.x0").alias("x0"))
    met = w.join(v_, ["document_id", "page", "campo", "kind", "tx", "ty"]).where(F.col("cell") != F.col("etiqueta"))
    below, drop, beside, gap = _reach(e, v)
    # a pair stands in several tiles; the one that holds the start of what both share tells it
    once = F.when(F.col("kind") == "below", F.col("tx") == F.floor(F.greatest(left, F.col("x0")) / TILE_X)).otherwise(True)
    near = met.where(once & F.when(F.col("kind") == "below", below).otherwise(beside))
    distance = F.greatest(F.when(F.col("kind") == "below", drop).otherwise(gap), F.lit(0.0))
    best = near.groupBy("document_id", "page", "campo", "etiqueta").agg(F.min(F.struct(distance.alias("distancia"), F.col("cell"), F.col("valor"))).alias("m"))
    return best.select("document_id", "page", "campo", "etiqueta", F.col("m.valor").alias("valor"), F.col("m.distancia").alias("distancia"))


def _nearest(cells: Column, campo: str, values: Column) -> Column:
    """The labels of a field among a page's cells with one of the field's values near them: an array of (campo, etiqueta, m: (distancia, cell, valor))."""

    def nearest(e: Column) -> Column:
        def met(v: Column) -> Column:
            below, drop, beside, gap = _reach(e, v)
            placed = (e["left"] + e["right"] + v["left"] + v["right"]).isNotNull()
            far = lambda by: F.greatest(by, F.lit(0.0))
            distance = F.when(v["cell"] != e["cell"], F.when(below & placed, far(drop)).when(beside, far(gap)))
            return F.struct(distance.alias("distancia"), v["cell"].alias("cell"), v["text"].alias("valor"))

        found = F.array_min(F.filter(F.transform(values, met), lambda m: m["distancia"].isNotNull()))
        return F.struct(F.lit(campo).alias("campo"), e["cell"].alias("etiqueta"), found.alias("m"))

    labels = F.filter(cells, lambda c: (F.size(values) > 0) & ~c["digit"] & c["text"].rlike(FIELDS[campo][0]))
    return F.filter(F.transform(labels, nearest), lambda b: b["m"].isNotNull())


def page_values(pages: DataFrame) -> DataFrame:
    """``labelled_values`` of whole pages: a row for each page, (document_id, page, valores), an array of (campo, etiqueta, m: (distancia, cell, valor)).

    Pages are (document_id, page, cells), an array of (cell, left, bottom, right, top, text). A page's labels meet all its values of their type in its
    own row, so this is for pages of up to some hundreds of cells; ``labelled_values`` takes any number.
    """
    at = lambda c, text: F.struct(c["cell"].alias("cell"), *(c[x].cast("double").alias(x) for x in CELL), text.alias("text"), c["text"].rlike(r"\d").alias("digit"))
    told = pages.select("document_id", "page", F.transform("cells", lambda c: at(c, stripped(c["text"]))).alias("cells"))

    def values(campo: str) -> Column:
        cut, check = CUTS[campo]
        texts = F.filter("cells", lambda c: c["digit"])
        if cut:
            texts = F.transform(texts, lambda c: c.withField("text", cut(c["text"])))
        return F.filter(texts, lambda v: check(v["text"]))

    read = told.select("document_id", "page", "cells", *(values(campo).alias(campo) for campo in FIELDS))
    return read.select("document_id", "page", F.concat(*(_nearest(F.col("cells"), campo, F.col(campo)) for campo in FIELDS)).alias("valores"))


def _header(found: DataFrame) -> DataFrame:
    """(document_id, numero, fecha) from (document_id, campo, valor, etiqueta), where a row without ``campo`` only tells that there is such a document."""
    votes = found.groupBy("document_id", "campo", "valor").agg(F.count("*").alias("n"), F.min("etiqueta").alias("first"))
    rank = F.struct((-F.col("n")).alias("n"), F.col("first"))
    return votes.groupBy("document_id").agg(*(F.min_by("valor", F.when(F.col("campo") == campo, rank)).alias(campo) for campo in FIELDS))


def header_from_cells(cells: DataFrame) -> DataFrame:
    """(document_id, numero, fecha), the values that most labels of a document have beside them, of equally many the one printed first; null where no label has any."""
    found = labelled_values(cells).select("document_id", "campo", "valor", "etiqueta")
    return _header(found.unionByName(cells.select("document_id").distinct(), allowMissingColumns=True))


def header_from_pages(pages: DataFrame) -> DataFrame:
    """``header_from_cells`` of whole pages, as ``page_values`` takes them. Pages that lie together by document are not dealt out again."""
    value = page_values(pages).select("document_id", F.explode_outer("valores").alias("x"))
    return _header(value.select("document_id", "x.campo", F.col("x.m.valor").alias("valor"), "x.etiqueta"))


def marks(texts: DataFrame) -> DataFrame:
    """from (document_id, text) the company names and tax ids in them (kind, offset, text), a name with its legal form and its line."""

    def of(k: int, text: str) -> Iterator[tuple]:
        for m in COMPANY.finditer(text):
            yield k, "name", m.start(), m[1], m[2], text[text.rfind("\n", 0, m.start()) + 1 :].split("\n", 1)[0]
        for m in COMPANY_ID.finditer(text):
            yield k, "id", m.start(), m[1] + m[2], None, None
        for m in PERSON_ID.finditer(text):
            yield k, "id", m.start(), m[1], None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for k, t in zip(b["document_id"], b["text"]) for x in of(k, t or "")], columns=["document_id", "kind", "offset", "text", "form", "line"])

    return texts.select("document_id", "text").mapInPandas(run, MARKS)


def supplier_names(texts: DataFrame, own_names: tuple[str, ...] = (), own_ids: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, cif, nombre) of each document's supplier.

    ``cif`` is the first tax id that isn't one's own. ``nombre`` is the company name nearest to any place of that id, of equally near ones the one
    printed more often, then first; names of one's own, or on a line with one's own id, don't count. Either is null where there is none.
    """
    found = marks(texts)
    ids = found.where((F.col("kind") == "id") & ~F.col("text").isin(*own_ids))
    places = ids.groupBy("document_id", "text").agg(F.array_agg("offset").alias("places"))
    first = places.groupBy("document_id").agg(F.min_by(F.struct("text", "places"), F.array_min("places")).alias("i")).select("document_id", F.col("i.text").alias("cif"), F.col("i.places").alias("places"))
    words = F.split("text", r"[ \t]+")
    start = F.array_position(F.transform(words, lambda w: ~name_key(w).isin(*NOT_A_NAME)), True)
    named = found.where("kind = 'name'").withColumn("start", start).where("start > 0").withColumn("name", F.array_join(F.slice(words, F.col("start").cast("int"), F.size(words)), " ")).withColumn("key", name_key(F.col("name")))
    line = F.upper(F.regexp_replace("line", "[- ]", ""))
    for own in own_names:
        named = named.where(~F.col("key").contains(name_key(F.lit(own))))
    for own in own_ids:
        named = named.where(~line.contains(own))
    gap = F.coalesce(F.array_min(F.transform("places", lambda p: F.abs(p - F.col("offset")))), F.lit(10**9))
    met = named.join(first, "document_id", "left").groupBy("document_id", "key").agg(F.min(gap).alias("gap"), F.count("*").alias("n"), F.min(F.struct("offset", F.concat_ws(" ", "name", "form").alias("shown"))).alias("f"))
    best = met.groupBy("document_id").agg(F.min(F.struct("gap", (-F.col("n")).alias("n"), "f")).alias("b")).select("document_id", F.col("b.f.shown").alias("nombre"))
    return texts.select("document_id").distinct().join(first.drop("places"), "document_id", "left").join(best, "document_id", "left")
