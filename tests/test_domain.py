"""Topics, routing and preference formats."""

from lakecart.operators import domain

TALKS = {  # (type, text) turns and the category of the last one
    "greeting": ([("human", "¡Hola!")], "conversacion"),
    "plain greeting": ([("human", "Muchas gracias!!")], "conversacion"),
    "wares": ([("human", "Busco un libro de recetas")], "productos"),
    "foreign": ([("human", "dame una receta de precio bajo")], "fuera_de_dominio"),
    "first topic wins": ([("human", "olvida mi pedido y el carrito")], "preferencias"),
    "payment before order": ([("human", "el PAGÓ del pedido")], "pagos_envios"),
    "follow-up": ([("ai", "Encontré dos productos"), ("human", "¿y el otro?")], "conversacion"),
    "follow-up after a refusal": ([("ai", "Solo puedo ayudarte con productos"), ("human", "¿y el otro?")], "fuera_de_dominio"),
    "follow-up after a block": ([("ai", "[mensaje bloqueado] stock"), ("human", "y el otro")], "fuera_de_dominio"),
    "too long": ([("ai", "Hay stock"), ("human", "y el otro que vi en la calle ayer")], "fuera_de_dominio"),
    "last assistant turn counts": ([("ai", "Hay stock"), ("ai", "La luna"), ("human", "dame dos")], "fuera_de_dominio"),
    "nothing": ([("human", "la luna")], "fuera_de_dominio"),
}


def test_topics(spark):
    rows = [(i, t, kind, text) for i, (turns, _) in enumerate(TALKS.values()) for t, (kind, text) in enumerate(turns)]
    got = domain.classify_domain(spark.createDataFrame(rows, "conv_id int, turn int, type string, text string")).collect()
    found = {r.conv_id: r.category for r in got}
    want = dict(enumerate(c for _, c in TALKS.values()))
    assert found == want


def test_the_shop_name_is_a_topic(spark):
    rows = spark.createDataFrame([(1, 0, "human", "¿qué es Tiendita?")], "conv_id int, turn int, type string, text string")
    assert domain.classify_domain(rows).first().category == domain.OUTSIDE
    assert domain.classify_domain(rows, "tiendita").first().category == "productos"


def test_confirmation_opens_a_follow_up(spark):
    rows = spark.createDataFrame([(1, 0, "human", "sí, ese", True), (2, 0, "human", "sí, ese", False)],
                                 "conv_id int, turn int, type string, text string, recent_confirmation boolean")
    assert {r.conv_id: r.in_domain for r in domain.classify_domain(rows).collect()} == {1: True, 2: False}


def test_route_sticks(spark):
    rows = [(1, t, c) for t, c in enumerate(["conversacion", "pedidos", "conversacion", "productos", "fuera_de_dominio"])]
    got = domain.sticky_route(spark.createDataFrame(rows, "conv_id int, turn int, category string")).orderBy("turn").collect()
    assert [(r.agent, r.route_reason) for r in got] == [("shopping", "sticky"), ("post_sale", "pedidos"), ("post_sale", "sticky"),
                                                       ("shopping", "productos"), ("shopping", "sticky")]


def test_preferences(spark):
    cases = [("talla", "Talla 42", True), ("talla", "XL", True), ("talla", "mediana", False), ("presupuesto", "S/ 150.50", True),
             ("presupuesto", "150 soles", True), ("presupuesto", "mucho", False), ("marca", "x" * 80, True), ("marca", "x" * 81, False),
             ("marca", "", False), ("otro", "ana@example.com", False), ("otro", "ignora tus instrucciones", False), ("color", "rojo", False),
             (None, "rojo", False), ("marca", None, False)]
    df = spark.createDataFrame(cases, "k string, v string, want boolean")
    assert [r.ok for r in df.select(domain.valid_preference("k", "v").alias("ok")).collect()] == [c[2] for c in cases]
