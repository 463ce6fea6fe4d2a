"""Data constants that results depend on, stated once and passed as defaults."""

# Defaults of arguments: model identifiers carried by the forecasts, and their display names.
RIVER_MODEL = "river"
GAUGE_MODEL = "gauge"
MODEL_LABELS = {"river": "River model", "gauge": "Gauge model"}

# Severity labels; the position in the tuple is the rank.
SEVERITIES = ("none", "warning", "danger", "extreme")

# River return period in years, lower bound -> severity.
RETURN_PERIOD_TIERS = ((20, "extreme"), (5, "danger"), (2, "warning"))

# Raw gauge label -> severity.
GAUGE_LABELS = {
    "ABOVE_NORMAL": "warning",
    "SEVERE": "danger",
    "EXTREME": "extreme",
}

# Exposure files, their value columns and the field each one feeds.
IMPACT_FILES = {
    "population_statistics.csv": {"pop_value": "population"},
    "building_statistics.csv": {"building_count": "buildings"},
    "farmland_statistics.csv": {"area_m2": "farmland_m2"},
    "transportation_statistics.csv": {"highway_km": "highway_km", "railway_km": "railway_km"},
}
IMPACT_FIELDS = ("population", "buildings", "farmland_m2", "highway_km", "railway_km")
IMPACT_WHOLE_FIELDS = ("population", "buildings", "farmland_m2")

# Property names of a forecast record, in output order.
FORECAST_FIELDS = (
    "model", "severity", "riverId", "country", "issuedTime", "startTime", "peakTime", "endTime",
    "returnPeriodYr", "peakDischargeCms", "historicalComparison", "lat", "lon",
)

# Fields of the detail view, in display order, with their captions.
DETAIL_FIELDS = (
    ("severity", "Severity"),
    ("riverId", "Gauge / River ID"),
    ("country", "Country"),
    ("returnPeriodYr", "Return period"),
    ("peakDischargeCms", "Mean discharge"),
    ("issuedTime", "Issued"),
    ("startTime", "Start"),
    ("peakTime", "Peak"),
    ("endTime", "End"),
    ("historicalComparison", "Historical"),
)

# Collection kinds and default resolutions.
KIND_BASINS = "basins-telescoping"
KIND_HEX = "h3-telescoping"
KIND_S2 = "s2-telescoping"
BASE_LEVEL = 8
BASIN_LEVELS = (8,)
HEX_RESOLUTIONS = (3, 4, 5, 6)
S2_LEVELS = (2, 3, 4, 5, 6, 7, 8)

# Zoom at which the first resolution shows, and zoom steps per further resolution.
FIRST_ZOOM = 2
ZOOM_STEP = 2

# Defaults of arguments: link patterns into the applications of the two models.
RIVER_LINK = "https://rivers.example/#lon={lon}&lat={lat}&zoom=13"
GAUGE_LINK = "https://gauges.example/l/{lat}/{lon}/10"
GAUGE_LINK_ID = "/g/{id}"

NO_VALUE = "—"
