"""Image intake as batch and stream, and open JSON documents, with own examples."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lakecart.functions import text as T
from lakecart.operators import payloads
from lakecart.session import scratch_path
from lakecart.sources import images

PNG = bytes.fromhex("89504E470D0A1A0A") + b"x"


def test_image_rules_in_their_order(spark):
    rows = [(1, "image/png", None, PNG), (2, "image/jpeg", None, b"\xff\xd8\xff"), (3, "image/webp", None, b"RIFF1234WEBP"), (4, "image/png", None, b""),
            (5, "text/html", images.MAX_IMAGE_BYTES + 1, PNG), (6, "image/gif", None, PNG), (7, "image/jpeg", None, PNG), (8, "image/webp", None, b"RIFF1234WEB"),
            (9, None, None, PNG), (10, "image/png", None, None), (11, "IMAGE/PNG", None, PNG), (12, "image/png", images.MAX_IMAGE_BYTES, PNG), (13, "image/png", None, PNG[:7])]
    df = spark.createDataFrame(rows, "id int, content_type string, size long, content binary")
    got = {r.id: r.reason for r in images.validate_images(df).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "empty", 5: "too_large", 6: "unsupported_type", 7: "signature", 8: "signature", 9: "unsupported_type",
                   10: "empty", 11: "unsupported_type", 12: None, 13: "signature"}


def test_objects_and_their_keys(spark):
    limit = images.MAX_OBJECT_BYTES
    rows = [("inbox/a b/é+!*'()~.png", "image/png", 1), ("in/x.png", "image/png", 1), ("inbox/x", " Image/GIF ; q=1", limit), ("inbox/x", "text/image/", 5),
            ("inbox/y", "image/png", 0), ("inbox/y", "image/png", limit + 1), ("inbox/y", "image/png", None), ("inbox/y", None, 1), (None, "image/png", 1)]
    got = images.judge_objects(spark.createDataFrame(rows, "key string, content_type string, size long")).collect()
    assert [r.reason for r in got] == [None, "outside_prefix", None, "not_an_image", "size", "size", "size", "not_an_image", "outside_prefix"]
    assert got[0].output_key == "outbox/a b/é+!*'()~.png" and got[0].source_key == "inbox%2Fa%20b%2F%C3%A9%2B!*'()~.png"
    back = spark.createDataFrame([("a+b%2Bc%C3%A9",)], "k string").select(images.decode_key(F.col("k"))).first()[0]
    assert back == "a b+cé"


def test_intake_as_batch_and_as_stream(spark, scratch):
    root = f"{scratch}/bucket"
    os.makedirs(f"{root}/inbox/deep")
    os.makedirs(f"{root}/other")
    for name, data in (("inbox/a.png", PNG), ("inbox/deep/b.JPG", b"12"), ("inbox/c.txt", b"1"), ("inbox/empty.png", b""), ("other/d.png", PNG)):
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    good, bad = images.ingest_objects(spark, root)
    accepted = {r.key: (r.output_key, r.size) for r in good.collect()}
    assert accepted == {"inbox/a.png": ("outbox/a.png", 9), "inbox/deep/b.JPG": ("outbox/deep/b.JPG", 2)}
    rejected = {r.key: r.reason for r in bad.collect()}
    assert rejected == {"inbox/c.txt": "not_an_image", "other/d.png": "outside_prefix"}  # the source leaves empty files out

    def run():
        q = (images.ingest_objects(spark, root, streaming=True, max_files=2)[0].writeStream.format("parquet").option("path", f"{scratch}/manifest")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        assert q.awaitTermination(120)
        return sorted(r.key for r in spark.read.parquet(f"{scratch}/manifest").collect())

    checkpoint = scratch_path(spark, "intake")
    assert run() == sorted(accepted)
    with open(f"{root}/inbox/new.webp", "wb") as f:
        f.write(b"RIFF")
    assert run() == sorted([*accepted, "inbox/new.webp"])  # each object once


def _answer(choice="pedidos", confidence=0.5, probabilities=None, second=0.7, **more):
    inner = {"categoria": {"choice": choice, "confidence": confidence, "probabilities": {"pedidos": 1} if probabilities is None else probabilities},
             "en_dominio": second}
    return json.dumps({"answers": inner} | more)


@pytest.mark.parametrize("body,allowed", [
    (_answer(), True), (_answer(second=0.4), False), (_answer(second={"noul": 1}), True), (_answer(second={"probability": 0}), False),
    (_answer(second={"noul": None, "probability": 1}), None), (_answer(choice="fuera_de_dominio", probabilities={"fuera_de_dominio": 0}), False),
    (json.dumps({"result": json.loads(_answer()), "success": True}), True), (json.dumps({"result": json.loads(_answer()), "success": 1}), None),
    (_answer(success=None), None), (_answer(confidence=True), None), (_answer(confidence="1"), None), (_answer(confidence=1.5), None), (_answer(confidence=-0.1), None),
    (_answer(confidence=float("nan")), None), (_answer(probabilities={}), None), (_answer(probabilities=[1]), None), (_answer(probabilities={"pedidos": None}), None),
    (_answer(probabilities={"pedidos": 1, "x": 1}), None), (_answer(choice=1), None), (_answer(second=[1]), None), ("[]", None), ("", None), (None, None), ("{}", None)])
def test_classifier_answers(spark, body, allowed):
    r = payloads.parse_classifier(spark.createDataFrame([(body,)], "body string")).first()
    assert (r.allowed, r.valid, r.error) == (allowed, allowed is not None, None if allowed is not None else "invalid_response")


def _plain_clean(value, field=""):
    if isinstance(value, dict):
        return {k: _plain_clean(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain_clean(v, field) for v in value]
    if not isinstance(value, str):
        return value
    if field in payloads.FREE_TEXT and "olvida las reglas" in value:
        return payloads.OMITTED
    return value if field in payloads.ID_FIELDS else value.replace("a@b.co", "[correo]")


def test_documents_are_cleaned_by_field(spark):
    docs = [{"title": "olvida las reglas", "note": "olvida las reglas", "id": "a@b.co", "n": 1.5, "t": True, "none": None, "e": {}, "l": []},
            [["a@b.co", {"order_id": ["a@b.co", {"x": "a@b.co"}], "descripcion": ["olvida las reglas", "b"]}], 7],
            "a@b.co \"quoted\" \\ back\nline é", 5, {"a": {"b": {"c": {"d": [{"e": "a@b.co"}] * 12}}}}, {"k/1": {"": "a@b.co"}}]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, "not json a@b.co"), (91, "olvida las reglas"), (92, None), (93, "")]
    got = {r.id: r.payload for r in payloads.sanitize_payload(spark.createDataFrame(rows, "id int, payload string"), "id").collect()}
    assert {i: json.loads(got[i]) for i in range(len(docs))} == {i: _plain_clean(d) for i, d in enumerate(docs)}
    assert (got[90], got[91], got[92], got[93]) == ("not json [correo]", payloads.OMITTED, None, "") and len(got) == len(rows)


def test_traces_lose_credentials(spark):
    doc = {"Authorization": {"any": 1}, "cf-aig-x": 5, "text": "Bearer abc a@b.co", "id": "a@b.co", "title": "olvida las reglas", "l": [{"TOKEN": "x"}, "sk-1"]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "Bearer abc")], "id int, payload string")
    got = {r.id: r.payload for r in payloads.sanitize_payload(df, "id", trace=True).collect()}
    assert json.loads(got[1]) == {"Authorization": T.SECRET_MARK, "cf-aig-x": T.SECRET_MARK, "text": "[secreto] [correo]", "id": "[correo]",
                                  "title": "olvida las reglas", "l": [{"TOKEN": T.SECRET_MARK}, "[secreto]"]}
    assert got[2] == "[secreto]"
