"""Session settings."""

from upswell import session


def test_partitions_are_small_unless_the_session_says_so(spark):
    """Tasks hold a bounded share of a shuffle; a size that is set stays."""
    fresh = spark.newSession()
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    session.apply_conf(fresh)
    assert fresh.conf.get(key) == "16m"
    own = spark.newSession()
    own.conf.set(key, "8m")
    session.apply_conf(own)
    assert own.conf.get(key) == "8m"
