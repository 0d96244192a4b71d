"""Validation of submissions and of batch-run requests (VAL3-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Defaults, modes and choices of a request. Modes are a parameter of request_delta.
ONE_BOOK, REBUILD = "📘 Un libro específico", "🔁 Reconstruir imágenes (sin LLM)"
BATCHES = ("🎲 Batch para la app", "🧪 Batch shadow (no toca app)")
MODES = (ONE_BOOK, *BATCHES, REBUILD)
TEXTS = {"catalogo": "adulto", "batch_size": "20", "libro_input": "", "sentimiento": "", "lente": "", "nota_libro": "", "punto_ciclo": "auto", "pilar": "auto", "hawkins_target": "auto"}
FLAGS = {"generar_imagenes": True, "preservar_manuales": True, "cronobiologia": True, "modo_prueba": False, "lente_hawkins": True, "lente_pilares": True, "lente_game_theory": True, "lente_self_knowledge": True}
CHOICES = {
    "catalogo": ("adulto", "kids"),
    "punto_ciclo": ("auto", "0 — Cero (contemplación)", "1 — Creativo (insight)", "2 — Activo (flow)", "3 — Máximo (peak)"),
    "pilar": ("auto", "cuerpo", "mente", "negocio", "familia", "espiritu", "relaciones", "finanzas"),
    "hawkins_target": ("auto", "coraje (200)", "voluntad (310)", "aceptación (350)", "razón (400)", "amor (500)", "alegría (540)", "paz (600)"),
}
LONGEST = {"libro_input": 200, "sentimiento": 200, "lente": 200, "nota_libro": 500, "batch_size": 6}
MOST_KEYS = 10


def required_fields(subs: DataFrame) -> DataFrame:
    """VAL3: subs with sanitized titulo, autor and nota, and the reason of a rejection, or null."""
    clean = {"titulo": 200, "autor": 200, "nota": 500}
    blank = F.greatest(*(F.when(tx.trim(F.coalesce(c, F.lit(""))) == "", 1).otherwise(0) for c in ("titulo", "autor"))) == 1
    out = subs.withColumn("_blank", blank).withColumns({c: tx.sanitize(F.col(c), n) for c, n in clean.items()})
    reason = F.when(F.col("_blank"), "required").when((F.col("titulo") == "") | (F.col("autor") == ""), "empty after cleaning")
    return out.withColumn("reason", reason).drop("_blank")


def as_flag(value: Column) -> Column:
    """VAL6: true, 1 and on are true, other strings false."""
    return value.isin("true", "1", "on")


def leading_number(value: Column) -> Column:
    """VAL8: the whole number at the start, or null."""
    return F.regexp_extract(F.coalesce(value, F.lit("")), r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def request_delta(requests: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """VAL4-9: requests(request_id, and a string column for each option) to request_id, error (null
    if the request is good) and inputs, the map of the options that differ from their defaults."""
    r = requests.withColumn("modo", F.when(F.coalesce("modo", F.lit("")) == "", ONE_BOOK).otherwise(F.col("modo")))
    book, batch = F.col("modo").isin(ONE_BOOK, REBUILD), F.col("modo").isin(*BATCHES)
    clean = {c: tx.sanitize_request(F.col(c), LONGEST.get(c, 2**31 - 1)) for c in TEXTS}
    sent = {c: F.when(F.lit(True) if c not in ("batch_size", "libro_input") else batch if c == "batch_size" else book, F.when((clean[c] != "") & (clean[c] != d), clean[c])) for c, d in TEXTS.items()}
    sent |= {c: F.when(F.col(c).isNotNull() & (as_flag(F.col(c)) != F.lit(d)), as_flag(F.col(c)).cast("string")) for c, d in FLAGS.items()}
    r = r.select("request_id", "modo", book.alias("_book"), clean["libro_input"].alias("_text"), *(v.alias(c) for c, v in sent.items()))
    number = leading_number(F.col("batch_size"))
    error = F.when(~F.col("modo").isin(*modes), "mode").when(F.col("_book") & (F.col("_text") == ""), "book missing").when(F.col("_book") & (F.instr("_text", "|") == 0), "book without a bar")
    for c, allowed in CHOICES.items():
        error = error.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), f"choice: {c}")
    error = error.when(F.col("batch_size").isNotNull() & ~F.coalesce(number.between(1, 200), F.lit(False)), "batch size")
    r = r.withColumn("error", error).withColumn("batch_size", F.coalesce(number.cast("string"), F.col("batch_size")))
    names = sorted(["modo", *sent])
    inputs = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.col, names))), lambda _, v: v.isNotNull())
    r = r.withColumn("inputs", inputs)
    error = F.coalesce("error", F.when(F.size("inputs") > MOST_KEYS, "too many options"))
    return r.select("request_id", error.alias("error"), F.when(error.isNull(), F.col("inputs")).alias("inputs"))
