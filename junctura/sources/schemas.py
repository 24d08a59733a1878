"""Declared schemas; no source is inferred."""

CRASH_TEXT_COLS = [
    "CASE_ID", "COLLISION_DATE", "COLLISION_SEVERITY", "POINT_X", "POINT_Y", "LATITUDE", "LONGITUDE", "STATE_HWY_IND",
    "PEDESTRIAN_ACCIDENT", "BICYCLE_ACCIDENT", "TYPE_OF_COLLISION", "LIGHTING", "ALCOHOL_INVOLVED", "PCF_VIOL_CATEGORY",
]
CANONICAL_REQUIRED = [("crash_id", "string"), ("date", "date"), ("lat", "double"), ("lon", "double"), ("severity", "int")]
CANONICAL_FLAGS = ["is_ped", "is_bike", "is_broadside", "is_left_turn", "is_dui", "is_night", "is_ped_row_violation",
                   "at_intersection", "is_state_highway"]
CANONICAL_ATTRS = ["functional_class", "place_name", "state_name"]
# The depth of the coordinates depends on the type, so they are read as text first.
GEOJSON_FEATURES = "features array<struct<geometry struct<type string, coordinates string>, properties map<string,string>>>"
OSM_ELEMENTS = ("elements array<struct<type string, id bigint, lat double, lon double, "
                "center struct<lat double, lon double>, nodes array<bigint>, "
                "geometry array<struct<lat double, lon double>>, tags map<string,string>>>")
PERMITS = ("record_id string, record_name string, business_type string, address string, city string, zip string, "
           "permit_status string, active_permit string, record_open_date string, latitude string, longitude string")
