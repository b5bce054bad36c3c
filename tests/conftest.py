import pytest

from loomwell.session import build_session

POSTS = "blog_id string, seq long, key string, url string, title string, html string, date string, modified string, author string, categories array<string>, tags array<string>, excerpt string, featured_image string, source string, fetched_at string"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[4]", 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")), "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_posts(spark):
    """posts rows from dicts; what isn't given is null, or a plain value for the keys."""

    def make(rows):
        names = [f.split()[0] for f in POSTS.split(", ")]
        full = []
        for i, r in enumerate(rows):
            base = {"blog_id": "demo", "seq": i, "key": f"k{i}", "fetched_at": "2026-01-01T00:00:00Z"} | r
            full.append(tuple(base.get(n) for n in names))
        return spark.createDataFrame(full, POSTS)

    return make


BLOGS = "blog_id string, timezone string, locale string"


@pytest.fixture(scope="session")
def make_blogs(spark):
    return lambda rows=(("demo", "Europe/Berlin", "de-DE"),): spark.createDataFrame(list(rows), BLOGS)
