"""The fixture views reproduce the facts FIXTURES.md records for sf0.01."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ratelake.operators import dashboard as D
from ratelake.operators import quality as Q
from ratelake.operators import stats as S
from ratelake.plans import fixtures as FX
from tests.conftest import SF_MID

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_MID), reason="driver tables not present")


def test_ratings_view(spark):
    r = FX.ratings(spark, SF_MID)
    assert r.count() == 60_000
    dup = Q.duplicate_summary(r).first()
    assert dup["duplicate_rows"] == 5
    keys = Q.distinct_count(r, "userId", "movieId").first()
    assert (keys["n_distinct_userId"], keys["n_distinct_movieId"]) == (1_500, 2_000)
    assert Q.distinct_rows(r, "userId", "movieId").first()["n_distinct"] == 59_391
    assert Q.valid_ratings(r, 1.0, 4.5).count() == 48_017
    stats = S.rating_stats(r, FX.movies(spark, SF_MID)).first()
    assert round(stats["mean_rating"], 4) == 2.7403 and round(stats["stddev_rating"], 6) == 1.436787


def test_movies_and_predictions_views(spark):
    genres = S.genre_stats(FX.ratings(spark, SF_MID), FX.movies(spark, SF_MID))
    assert genres.count() == 31
    p = FX.predictions(spark, SF_MID)
    as_of = D.resolve_as_of(p)
    s = D.dash_summary(p, as_of).first()
    assert s["total_predictions"] == 10_000 and s["active_users_24h"] == 133
    assert D.last_hours(p, as_of).count() == 329
    assert D.dash_activity(p, as_of).count() == 24
    assert p.select(F.countDistinct("prediction")).first()[0] == 6_583
