"""Place-based risk analytics as Spark jobs.

Events are snapped to sites, turned into leakage-walled panels, described by
history, trend, road and neighbourhood features, scored, ranked, evaluated and
exported, all as DataFrame plans.
"""
