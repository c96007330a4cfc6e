"""The cover image of an article: images of its head, of its data and of its text as rows, scored, the best one kept.

Where an image stands in the text is a running count over the page's elements, so a page is sorted once; what its name
shares with the title is counted against the title's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import collapsed, comparable, let, token_overlap, tokens
from tidemark.functions.urls import path_of, resolved, slug_of_path, srcset

#: The least score of a cover, images of a text that are looked at, and where an article's images are sought.
LEAST, MOST_IMAGES = 32, 6
BODY_CLASSES = ("post-content", "entry-content", "article-content", "article-body", "post-body")
#: Kinds of articles in a page's data, and what each of its statements is worth.
ARTICLE_KINDS = ("article", "blogposting", "newsarticle", "reportagearticle", "analysisnewsarticle", "opinionnewsarticle")
STATEMENTS = ((("headline", "name"), 8), (("datePublished", "dateCreated"), 5), (("articleBody", "description"), 3))
PICTURED = 6
#: What an image is worth by where it was found.
WORTH = {"jsonld-image": 42, "article-header": 40, "meta-og": 34, "meta-twitter": 30, "jsonld-thumbnail": 28, "article-image": 26}
#: Texts before an image (at most, worth; beyond, cost) and its shorter side (at least, worth).
BEFORE, FAR = ((0, 12), (2, 6), (4, -6)), -18
SIDES = ((900, 18), (500, 12), (240, 4))
#: More for an image in a header; small, small and square, and worthless images; a told image; words shared.
IN_HEADER, SMALL, SMALL_COST, SQUARE, SQUARE_APART, SQUARE_COST = 12, 180, -60, 240, 32, -45
TOLD, TOLD_WORTH, A_WORD, MOST_WORDS, WORTHLESS = 16, 5, 2, 8, -120
#: What the names and places of images that are no covers hold.
LOW_VALUE = (r"\bavatar\b", r"\bprofile(?:[_ -]?photo)?\b", r"\bauthor[-_ ]?avatar\b", r"\bu-photo\b", r"\bheadshot\b", r"\bportrait\b", r"\blogo\b", r"\bfavicon\b", r"\bicon\b", r"\bemoji\b", r"/avatars?/", r"/profile_images?/", r"/gravatar/")

_IMAGE = "struct<place:struct<source:int,at:int>,found:string,url:string,alt:string,width:int,height:int,before:int,hint:string>"
_EARLY = Window.unboundedPreceding


def _some(text: Column) -> Column:
    """A text with its white space collapsed, null for a blank one."""
    return F.when(collapsed(text) != "", collapsed(text))


def _number(text: Column) -> Column:
    """The digits at the beginning of a text."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int")


def image_url(base: Column, value: Column) -> Column:
    """An image's address, resolved; what an image server wraps is taken out."""

    def unwrapped(u: Column) -> Column:
        inner = F.regexp_extract(u, r"[?&]url=([^&#]+)", 1)
        return F.when((path_of(u) == "/_next/image") & (inner != ""), resolved(base, F.try_url_decode(inner))).otherwise(u)

    return let(resolved(base, _some(value)), unwrapped)


def _image(**columns: Column) -> Column:
    none = {"alt": "string", "width": "int", "height": "int", "before": "int", "hint": "string"}
    given = {k: columns.get(k, F.lit(None).cast(t)) for k, t in none.items()}
    place = F.struct(F.lit(columns["source"]).alias("source"), columns["at"].cast("int").alias("at"))
    return F.struct(place.alias("place"), columns["found"].alias("found"), columns["url"].alias("url"), *(given[k].cast(t).alias(k) for k, t in none.items())).cast(_IMAGE)


def head_images(nodes: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """The images that a page's head names for others who show it."""
    attrs = F.col("attrs")
    name = F.lower(F.trim(F.coalesce(attrs["property"], attrs["name"], attrs["itemprop"])))
    said = nodes.filter(F.col("tag") == "meta").select(key, "pre", name.alias("name"), _some(attrs["content"]).alias("said")).filter("said IS NOT NULL")
    wanted = ("og:image", "og:image:url", "og:image:alt", "og:image:width", "og:image:height", "twitter:image", "twitter:image:alt")
    first = said.filter(F.col("name").isin(*wanted)).groupBy(key).agg(*(F.min_by(F.when(F.col("name") == w, F.col("said")), F.when(F.col("name") == w, F.col("pre"))).alias(w.replace(":", "_")) for w in wanted))
    rows = first.join(pages.select(key, "url"), key)
    og = _image(source=0, at=F.lit(0), found=F.lit("meta-og"), url=image_url(F.col("url"), F.coalesce("og_image", "og_image_url")), alt=F.col("og_image_alt"), width=_number(F.col("og_image_width")), height=_number(F.col("og_image_height")), hint=F.lit("meta-og"))
    other = _image(source=0, at=F.lit(1), found=F.lit("meta-twitter"), url=image_url(F.col("url"), F.col("twitter_image")), alt=F.col("twitter_image_alt"), hint=F.lit("meta-twitter"))
    return rows.select(key, F.explode(F.array(og, other)).alias("image"))


def data_images(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The images of the article that a page's JSON-LD tells most of; lists and graphs are opened two levels deep."""
    text = lambda v, *names: F.coalesce(*(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING", F.try_variant_get(v, f"$.{n}", "string")) for n in names))
    is_list = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    listed = lambda v: F.when(is_list(v), F.try_variant_get(v, "$", "array<variant>")).when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<variant>"))
    graph = lambda v: listed(F.try_variant_get(v, "$['@graph']", "variant"))
    opened = lambda objects: F.flatten(F.transform(objects, lambda v: F.concat(graph(v), F.array(v))))

    scripts = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script"), F.lit(1))
    parsed = pages.select(key, "url", F.posexplode(scripts).alias("nth", "raw")).withColumn("v", F.try_parse_json(F.trim("raw"))).filter("v IS NOT NULL")
    objects = parsed.select(key, "url", "nth", F.posexplode(opened(opened(listed(F.col("v"))))).alias("at", "v"))
    v = F.col("v")
    kinds = F.transform(listed(F.try_variant_get(v, "$['@type']", "variant")), lambda k: F.lower(F.trim(F.try_variant_get(k, "$", "string"))))
    is_article = F.exists(kinds, lambda k: F.coalesce(k.isin(*ARTICLE_KINDS), F.lit(False)))
    images, thumbs = F.try_variant_get(v, "$.image", "variant"), F.try_variant_get(v, "$.thumbnailUrl", "variant")
    told = F.when(images.isNotNull() | thumbs.isNotNull(), PICTURED).otherwise(0)
    for names, worth in STATEMENTS:
        told = told + F.when(text(v, *names).isNotNull(), worth).otherwise(0)
    articles = objects.filter(is_article).groupBy(key).agg(F.min_by(F.struct("v", "url"), F.struct((-told).alias("told"), "nth", "at")).alias("best"))
    v, url = F.col("best.v"), F.col("best.url")
    images, thumbs = listed(F.try_variant_get(v, "$.image", "variant")), listed(F.try_variant_get(v, "$.thumbnailUrl", "variant"))
    tagged = lambda found, values: F.transform(values, lambda x: F.struct(F.lit(found).alias("found"), x.alias("v")))
    each = articles.select(key, url.alias("base"), F.posexplode(F.concat(tagged("jsonld-image", images), tagged("jsonld-thumbnail", thumbs))).alias("at", "x"))
    x = F.col("x.v")
    address = F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(text(x, "url", "contentUrl"))
    return each.select(key, _image(source=1, at=F.col("at"), found=F.col("x.found"), url=image_url(F.col("base"), address), alt=text(x, "caption", "description", "name"), width=_number(text(x, "width")), height=_number(text(x, "height")), hint=F.col("x.found")).alias("image"))


def image_root(nodes: DataFrame, key: str) -> DataFrame:
    """(key, root, root_last): the element that is an article by its kind and has the longest text."""
    tag, attrs = F.col("tag"), F.col("attrs")
    classes = F.split(F.coalesce(attrs["class"], F.lit("")), r"\s+")
    choice = F.when(tag == "article", 0).when(F.coalesce(attrs["itemprop"] == "articleBody", F.lit(False)), 1)
    for k, name in enumerate(BODY_CLASSES, 2):
        choice = choice.when(F.array_contains(classes, name), k)
    choice = choice.when(tag == "main", 2 + len(BODY_CLASSES))
    best = nodes.withColumn("choice", choice).filter("choice IS NOT NULL").groupBy(key).agg(F.max_by(F.struct("pre", "last"), F.struct("length", -F.col("choice"), -F.col("pre"))).alias("r"))
    return best.select(key, F.col("r.pre").alias("root"), F.col("r.last").alias("root_last"))


def _widest(base: Column, image: Column, sources: Column) -> Column:
    """(url, width, height) of an image's widest, then highest, then first address."""
    named = lambda *names: F.coalesce(*(image[n] for n in names))
    one = lambda value: F.array(F.struct(image_url(base, value).alias("url"), _number(image["width"]).alias("width"), _number(image["height"]).alias("height")))
    many = lambda a: F.transform(srcset(F.coalesce(a["srcset"], a["data-srcset"], F.lit(""))), lambda s: F.struct(image_url(base, s["url"]).alias("url"), F.coalesce(s["width"], _number(a["width"])).alias("width"), _number(a["height"]).alias("height")))
    every = F.concat(one(named("data-current-src")), many(image), one(named("src", "data-src", "data-original")), F.flatten(F.transform(sources, many)))
    ranked = F.transform(every, lambda s, k: F.struct(F.coalesce(s["width"], F.lit(-1)).alias("w"), F.coalesce(s["height"], F.lit(-1)).alias("h"), (-k).alias("k"), s.alias("s")))
    return F.array_max(F.filter(ranked, lambda r: r["s"]["url"].isNotNull()))["s"]


def text_images(nodes: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """The first images of the article's text: figures with an image, and images that stand in no figure."""
    whole = Window.partitionBy(key).orderBy("pre").rowsBetween(_EARLY, 0)
    tag, attrs = F.col("tag"), F.col("attrs")
    within = lambda kind: F.coalesce(F.max(F.when(tag == kind, F.col("last"))).over(whole) >= F.col("pre"), F.lit(False))
    hint = F.concat(tag, F.coalesce(F.concat(F.lit("#"), F.when(attrs["id"] != "", attrs["id"])), F.lit("")), F.coalesce(F.concat(F.lit("."), F.when(attrs["class"] != "", collapsed(attrs["class"]))), F.lit("")))
    # The last figure that has begun, its captions and the sources of a picture are met before or after the image.
    placed = nodes.join(image_root(nodes, key), key).select("*", hint.alias("hint"), within("header").alias("in_header"), F.count_if(tag.isin("p", "blockquote", "ul", "ol") & F.col("pre").between(F.col("root") + 1, F.col("root_last"))).over(whole).alias("before"))
    inner = placed.filter((F.col("pre") > F.col("root")) & (F.col("pre") <= F.col("root_last")))
    figure = F.last(F.when(tag == "figure", F.struct("pre", "last", "before")), ignorenulls=True).over(Window.partitionBy(key).orderBy("pre").rowsBetween(_EARLY, 0))
    marked = inner.withColumn("figure", figure).withColumn("figure", F.when(F.col("figure.last") >= F.col("pre"), F.col("figure")))
    pictures = nodes.filter(tag == "source").groupBy(key, "parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", F.struct(*(attrs[a].alias(a) for a in ("srcset", "data-srcset", "width", "height"))).alias("a")))), lambda s: s["a"]).alias("sources"))
    captions = marked.filter((tag == "figcaption") & F.col("figure").isNotNull()).groupBy(key, F.col("figure.pre").alias("figure_pre")).agg(F.min_by("text", "pre").alias("caption"))
    images = marked.filter(tag == "img").withColumn("figure_pre", F.col("figure.pre"))
    # The elements around an image, three of them, are part of what tells its worth.
    around = nodes.select(key, F.col("pre").alias("parent"), F.col("parent").alias("next"), hint.alias("around"), F.col("tag").alias("around_tag"))
    for k in range(3):
        images = images.join(around, [key, "parent"], "left")
        if k == 0:
            images = images.withColumn("own_parent", F.col("parent")).withColumn("parent_tag", F.col("around_tag"))
        images = images.withColumn("hint", F.concat_ws(" ", "hint", "around")).withColumn("parent", F.col("next")).drop("next", "around", "around_tag")
    rows = images.join(pictures.withColumnRenamed("parent", "own_parent"), [key, "own_parent"], "left").join(captions, [key, "figure_pre"], "left").join(pages.select(key, "url"), key)
    picture = F.coalesce(F.col("parent_tag") == "picture", F.lit(False))
    sources = F.when(picture & F.col("sources").isNotNull(), F.col("sources")).otherwise(F.array().cast("array<struct<srcset:string,`data-srcset`:string,width:string,height:string>>"))
    rows = rows.withColumn("widest", _widest(F.col("url"), attrs, sources)).filter("widest IS NOT NULL")
    # A figure counts once, by its first image, where the figure stands; an image right in a figure only so.
    first = F.row_number().over(Window.partitionBy(key, "figure_pre").orderBy("pre")) == 1
    both = rows.withColumn("first", F.col("figure_pre").isNotNull() & first)
    in_figure = F.struct(F.col("figure_pre").alias("at"), F.col("figure.before").alias("before"), F.coalesce(attrs["alt"], F.col("caption")).alias("alt"))
    alone = F.struct(F.col("pre").alias("at"), F.col("before").alias("before"), attrs["alt"].alias("alt"))
    stands = F.filter(F.array(F.when(F.col("first"), in_figure), F.when(F.coalesce(F.col("parent_tag") != "figure", F.lit(True)), alone)), lambda s: s.isNotNull())
    each = both.withColumn("s", F.explode(stands))
    once = each.withColumn("again", F.row_number().over(Window.partitionBy(key, "widest.url").orderBy("s.at"))).filter("again = 1")
    few = once.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("s.at"))).filter(F.col("nth") <= MOST_IMAGES)
    found = F.when(F.col("in_header"), "article-header").otherwise("article-image")
    return few.select(key, _image(source=2, at=F.col("nth"), found=found, url=F.col("widest.url"), alt=F.col("s.alt"), width=F.col("widest.width"), height=F.col("widest.height"), before=F.col("s.before"), hint=F.col("hint")).alias("image"))


def _worth(c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in WORTH.items() for x in pair))[c["found"]], F.lit(20))


def _one_of_each(images: Column) -> Column:
    """Of the records of one address in order: a later one counts if it was found in a better place, or is larger."""
    size = lambda n: F.coalesce(n, F.lit(-1))
    better = lambda a, b: (_worth(b) > _worth(a)) | (size(b["width"]) > size(a["width"])) | (size(b["height"]) > size(a["height"]))
    return F.aggregate(images, F.get(images, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))


def cover_score(image: Column, words: Column, author: Column, site: Column) -> Column:
    """What an image is worth as the cover of an article whose title and address have these words."""
    width, height, before = image["width"], image["height"], image["before"]
    longest, shortest = F.greatest(F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))), F.least(width, height)
    stands, side = F.when(before.isNull(), 0), F.when(shortest.isNull(), 0)
    for most, worth in BEFORE:
        stands = stands.when(before <= most, worth)
    for least, worth in SIDES:
        side = side.when(shortest >= least, worth)
    square = width.isNotNull() & height.isNotNull() & (longest <= SQUARE) & (F.abs(width - height) <= SQUARE_APART)
    shared = token_overlap(image["url"], words)
    place = F.lower(F.concat_ws(" ", image["url"], F.when(image["alt"] != "", image["alt"]), image["hint"]))
    alt = comparable(F.coalesce(image["alt"], F.lit("")))
    named = (alt != "") & (F.coalesce(alt == comparable(author), F.lit(False)) | F.coalesce(alt == comparable(site), F.lit(False)))
    return (
        _worth(image)
        + stands.otherwise(FAR)
        + F.when(image["found"] == "article-header", IN_HEADER).otherwise(0)
        + side.otherwise(0)
        + F.when((longest > 0) & (longest <= SMALL), SMALL_COST).otherwise(0)
        + F.when(square, SQUARE_COST).otherwise(0)
        + F.when(F.length(image["alt"]) >= TOLD, TOLD_WORTH).otherwise(0)
        + F.least(F.lit(MOST_WORDS), A_WORD * shared)
        + F.when(place.rlike("|".join(LOW_VALUE)) | named, WORTHLESS).otherwise(0)
    )


def cover_candidates(nodes: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, place, found, url, alt, width, height, before, hint, score): each image of a page once, with its score.

    pages: key, url, html, title, author and site (null where unknown). nodes: the pages' elements. place orders a page's
    images: those its head names, those of its data, those of its text. Images without a usable address have no row.
    """
    images = head_images(nodes, pages, key).unionByName(data_images(pages, key)).unionByName(text_images(nodes, pages, key)).filter("image.url IS NOT NULL")
    clean = images.withColumn("image", F.col("image").withField("alt", _some(F.col("image.alt"))))
    each = clean.groupBy(key, F.col("image.url").alias("address")).agg(F.array_sort(F.collect_list("image")).alias("images"))
    kept = each.select(key, F.get("images", F.lit(0))["place"].alias("place"), _one_of_each(F.col("images")).alias("image"))
    words = F.array_distinct(F.concat(tokens(F.coalesce("title", F.lit(""))), tokens(F.coalesce(slug_of_path(F.col("url")), F.lit("")))))
    about = pages.select(key, words.alias("words"), "author", "site")
    scored = kept.join(about, key).withColumn("score", cover_score(F.col("image"), F.col("words"), F.col("author"), F.col("site")))
    return scored.select(key, "place", "image.found", "image.url", "image.alt", "image.width", "image.height", "image.before", "image.hint", "score")


def covers(nodes: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, cover, found, score) of each page that has a cover: the best image, by score, width, height and place.

    A page whose best image scores less than LEAST has no row, as has one without images.
    """
    size = lambda n: F.coalesce(F.col(n), F.lit(-1))
    order = F.struct("score", size("width").alias("w"), size("height").alias("h"), (-F.col("place.source")).alias("s"), (-F.col("place.at")).alias("a"))
    best = cover_candidates(nodes, pages, key).groupBy(key).agg(F.max_by(F.struct("url", "found", "score"), order).alias("b"))
    return best.filter(F.col("b.score") >= LEAST).select(key, F.col("b.url").alias("cover"), "b.found", "b.score")
