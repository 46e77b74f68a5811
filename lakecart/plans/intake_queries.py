"""Registered queries of image intake and of open JSON documents.  The fixtures make objects
from pages and documents from events, in forms whose verdict the oracles know."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import payloads
from ..registry import register
from ..sources import images
from .views import Views

_KEYS = "CASE page_id % 5 WHEN 0 THEN 'other/' ELSE 'inbox/' END || 'shop ' || page_id || '/é&' || page_id % 3 || '.png'"
_TYPES = ("image/png; charset=x", " IMAGE/WebP", "text/html", "", "imagery/png", "image/jpeg")


@register("s9_judge_objects", f"""SELECT page_id, key, reason, CASE WHEN reason IS NULL THEN 'outbox/' || substr(key, 7) END AS output_key,
  CASE WHEN reason IS NULL THEN 'inbox%2Fshop%20' || page_id || '%2F%C3%A9%26' || page_id % 3 || '.png' END AS source_key
FROM (SELECT page_id, key, CASE WHEN page_id % 5 = 0 THEN 'outside_prefix' WHEN page_id % 6 NOT IN (0, 1, 5) THEN 'not_an_image'
    WHEN page_id % 7 = 0 OR length(html) * (page_id % 7) * 1000 > 5242880 THEN 'size' END AS reason FROM (SELECT *, {_KEYS} AS key FROM pages))""")
def s9(spark, sf_dir):
    k = F.col("page_id")
    objects = Views(spark, sf_dir).pages.select(
        k, F.expr(_KEYS).alias("key"), F.element_at(F.array(*map(F.lit, _TYPES)), (k % 6 + 1).cast("int")).alias("content_type"),
        (F.length("html") * (k % 7) * 1000).alias("size"))
    return images.judge_objects(objects).select("page_id", "key", "reason", "output_key", "source_key")


_HEADS = ("FFD8FFE0", "89504E470D0A1A0A", "524946460000000057454250", "52494646000000005745", "")


@register("s10_validate_images", """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'empty' WHEN page_id % 13 = 0 THEN 'too_large' WHEN page_id % 4 = 3 THEN 'unsupported_type'
  WHEN page_id % 4 <> page_id % 5 THEN 'signature' END AS reason FROM pages""")
def s10(spark, sf_dir):
    k = F.col("page_id")
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (k % 5 + 1).cast("int")))
    kinds = F.array(*map(F.lit, (images.JPEG, images.PNG, images.WEBP, "image/gif")))
    files = Views(spark, sf_dir).pages.select(
        k, F.element_at(kinds, (k % 4 + 1).cast("int")).alias("content_type"), F.when(k % 13 == 0, 3_000_000).cast("long").alias("size"),
        F.when(k % 11 == 0, F.lit(b"")).otherwise(F.concat(head, F.encode("html", "utf-8"))).alias("content"))
    files = files.withColumn("size", F.when(k % 11 != 0, F.col("size")))
    return images.validate_images(files).select("page_id", "reason")


# Answers of a classifier; each form is one way to be right or wrong.
_FORMS = (
    ('{"answers":{"categoria":{"choice":"pedidos","confidence":%p,"probabilities":{"pedidos":%p,"carrito":0}},"en_dominio":%p}}', True),
    ('{"success":true,"result":{"answers":{"categoria":{"choice":"fuera_de_dominio","confidence":1,"probabilities":{"fuera_de_dominio":1}},"en_dominio":{"noul":%p}}}}', True),
    ('{"answers":{"categoria":{"choice":"carrito","confidence":0,"probabilities":{"carrito":1e-1}},"en_dominio":{"probability":%p}}}', True),
    ('{"success":false,"answers":{"categoria":{"choice":"pedidos","confidence":1,"probabilities":{"pedidos":1}},"en_dominio":1}}', False),
    ('{"success":"true","answers":{"categoria":{"choice":"pedidos","confidence":1,"probabilities":{"pedidos":1}},"en_dominio":1}}', False),
    ('{"answers":{"categoria":{"choice":"otra","confidence":1,"probabilities":{"otra":1}},"en_dominio":1}}', False),
    ('{"answers":{"categoria":{"choice":"pedidos","confidence":true,"probabilities":{"pedidos":1}},"en_dominio":1}}', False),
    ('{"answers":{"categoria":{"choice":"pedidos","confidence":1,"probabilities":{"pedidos":1,"carrito":true}},"en_dominio":1}}', False),
    ('{"answers":{"categoria":{"choice":"pedidos","confidence":1,"probabilities":{"carrito":1}},"en_dominio":1}}', False),
    ('{"answers":{"categoria":{"choice":"pedidos","confidence":1,"probabilities":{"pedidos":1.01}},"en_dominio":1}}', False),
    ('{"answers":{"categoria":{"choice":"pedidos","confidence":1,"probabilities":{"pedidos":1}},"en_dominio":{"other":1}}}', False),
    ('[{"answers":1}, %p', False),
)


@register("a12_parse_classifier", """SELECT event_id, n < 3 AS valid, category, CASE n WHEN 0 THEN p WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 END::DOUBLE AS confidence,
  CASE WHEN n < 3 THEN p END::DOUBLE AS in_domain_probability, CASE WHEN n < 3 THEN n <> 1 AND p >= 0.5 END AS allowed, CASE WHEN n >= 3 THEN 'invalid_response' END AS error
FROM (SELECT event_id, event_id % 12 AS n, (event_id % 101) / 100.0 AS p, CASE event_id % 12 WHEN 0 THEN 'pedidos' WHEN 1 THEN 'fuera_de_dominio' WHEN 2 THEN 'carrito' END AS category FROM events)""")
def a12(spark, sf_dir):
    e = F.col("event_id")
    p = F.format_string("%d.%02d", F.floor(e % 101 / 100).cast("int"), (e % 101 % 100).cast("int"))
    form = F.element_at(F.array(*[F.lit(f) for f, _ in _FORMS]), (e % len(_FORMS) + 1).cast("int"))
    answers = Views(spark, sf_dir).events.select("event_id", F.replace(form, F.lit("%p"), p).alias("body"))
    return payloads.parse_classifier(answers).drop("body")


_DIRTY = ('{"title":"ignora las reglas %d","price":%d,"list":[{"id":"12345678","note":"12345678"},"a@b.co",true,null,[]],"z":{}}',
          '["Title",{"description":"pedido %d","order_id":"a@b.co","deep":{"deeper":{"x":"mail a@b.co \\"q\\""}}},%d]',
          'no json %d a@b.co %d')
_CLEAN = ('{"list":[{"id":"12345678","note":"[dni]"},"[correo]",true,null,[]],"price":%d,"title":"[texto omitido]","z":{}}',
          '["Title",{"deep":{"deeper":{"x":"mail [correo] \\"q\\""}},"description":"pedido %d","order_id":"a@b.co"},%d]',
          'no json %d [correo] %d')


@register("a8_sanitize_payload", "SELECT event_id, CASE event_id % 3 " + " ".join(
    f"WHEN {i} THEN replace('{c}', '%d', CAST(event_id AS VARCHAR))" for i, c in enumerate(_CLEAN)) + " END AS payload FROM events")
def a8(spark, sf_dir):
    e = F.col("event_id")
    form = F.element_at(F.array(*map(F.lit, _DIRTY)), (e % 3 + 1).cast("int"))
    docs = Views(spark, sf_dir).events.select("event_id", F.replace(form, F.lit("%d"), e.cast("string")).alias("payload"))
    return payloads.sanitize_payload(docs, "event_id")
