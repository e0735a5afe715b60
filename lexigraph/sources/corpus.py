"""The bundled corpus for clustering: every topic of a category in every template of that category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The corpus version, topics as "a | b | c" and templates with {a}, {b}, {c}, all in corpus order.
VERSION = "task2-topic-separated-v2"
TOPICS = {
    "Economics": """
        inflation | central banks | interest rates
        household spending | consumer confidence | retail sales
        employment growth | wage pressure | labour markets
        currency depreciation | exports | trade balance
        public debt | government borrowing | bond yields
        energy prices | manufacturing costs | supply chains
        housing demand | mortgage rates | property prices
        tax policy | business investment | economic growth
        stock markets | corporate earnings | investor sentiment
        bank lending | small businesses | credit conditions
        global trade | shipping costs | import prices
        productivity | technology adoption | output per worker
        recession risk | consumer demand | forecast models
        foreign investment | infrastructure projects | regional development
        food prices | agricultural output | household budgets
    """,
    "Entertainment": """
        film festival | independent directors | international awards
        streaming platform | new drama series | viewer ratings
        music tour | stadium concerts | ticket sales
        television comedy | season finale | audience reaction
        video game release | online players | review scores
        theatre production | stage performers | opening night
        celebrity interview | fashion event | social media
        animation studio | family audience | box office
        documentary film | cultural history | critics
        award ceremony | red carpet | nominations
        pop album | music charts | radio play
        reality show | contestants | public voting
        comedy special | live audience | stand-up performance
        art exhibition | gallery visitors | creative installations
        dance performance | choreography | festival programme
    """,
    "Politics": """
        parliament debate | new legislation | opposition parties
        election campaign | voter turnout | policy promises
        foreign minister | diplomatic talks | regional security
        public health policy | government funding | local councils
        climate bill | energy targets | parliament committee
        budget statement | tax changes | cabinet ministers
        constitutional reform | legal experts | public consultation
        immigration policy | border rules | human rights groups
        education reform | school funding | teacher unions
        defence strategy | military spending | international allies
        mayoral election | city transport | campaign pledges
        anti-corruption inquiry | public officials | ethics rules
        trade agreement | negotiators | national parliament
        judicial appointment | senate hearing | legal committee
        local government | planning rules | community services
    """,
}
TEMPLATES = {
    "Economics": """
        Economics finance market {a}, {b}, and {c} inflation interest investment trade bank company price wage productivity growth.
        Business economy banking {a}, {b}, and {c} investor credit consumer export import revenue employment household retail.
        Financial monetary fiscal {a}, {b}, and {c} debt mortgage manufacturing supply chain output budget property market.
    """,
    "Entertainment": """
        Entertainment film music {a}, {b}, and {c} audience cinema actor performer festival award celebrity streaming theatre.
        Culture media television {a}, {b}, and {c} album concert comedy game gallery fans critics red carpet box office.
        Creative arts performance {a}, {b}, and {c} director musician choreography stage animation documentary reality show review.
    """,
    "Politics": """
        Politics government parliament {a}, {b}, and {c} legislation election minister party voter law senate cabinet policy campaign.
        Public policy state {a}, {b}, and {c} opposition diplomat council committee constitutional immigration defence judicial reform.
        Government political authority {a}, {b}, and {c} debate bill official mayoral anticorruption national local service rule.
    """,
}


def lines(block: str) -> list[str]:
    return [line.strip() for line in block.strip().splitlines()]


def corpus(spark: SparkSession) -> DataFrame:
    """id, ordinal, category, text in corpus order: by category, topic and template."""
    order = {category: i for i, category in enumerate(TOPICS)}
    topics = spark.createDataFrame([(order[c], c, i, *line.split(" | ")) for c in TOPICS for i, line in enumerate(lines(TOPICS[c]))], "c int, category string, topic int, a string, b string, c_ string")
    templates = spark.createDataFrame([(c, i, line) for c in TEMPLATES for i, line in enumerate(lines(TEMPLATES[c]))], "category string, template int, text string")
    filled = F.replace(F.replace(F.replace("text", F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b")), F.lit("{c}"), F.col("c_"))
    per_topic, per_category = 3, 45
    ordinal = (F.col("c") * per_category + F.col("topic") * per_topic + F.col("template")).cast("bigint")
    return topics.join(F.broadcast(templates), "category").select(ordinal.alias("id"), ordinal.alias("ordinal"), "category", filled.alias("text"))
