"""Fixed values of the vehicle-position data and of the stop questions.

Everything here must keep these exact values for results to agree with the
original pipeline: the raw file layout, the time text format, the stop bands
and the page sizes of the reports.
"""

# --- Fixed values: raw position files -------------------------------------
# Header text that daily files glue in front of their first data row.
RAW_HEADER = "REV,REPORT_TIME,VEHICLE_TAG,LONGITUDE,LATITUDE,SPEED,HEADING,TRAIN_ASSIGNMENT,PREDICTABLE"
# Field order of one raw line.
RAW_FIELDS = (
    "rev",
    "report_time",
    "vehicle_tag",
    "longitude",
    "latitude",
    "speed",
    "heading",
    "train_assignment",
    "predictable",
)
# Text format of REPORT_TIME (MM/DD/YYYY HH24:MI:SS).
RAW_TIME_FORMAT = "MM/dd/yyyy HH:mm:ss"
# Text columns are cut to this many characters when typed (SUBSTRING FROM 0 FOR 50).
TEXT_KEEP_CHARS = 49

# --- Fixed values: reference tables ---------------------------------------
TRANSIT_STOP_FIELDS = (
    "stop_lat",
    "stop_code",
    "stop_lon",
    "stop_url",
    "stop_id",
    "stop_desc",
    "stop_name",
    "location_type",
    "zone_id",
)
TRANSIT_STOP_DOUBLE_FIELDS = ("stop_lat", "stop_lon")
TRIP_FIELDS = (
    "block_id",
    "route_id",
    "original_trip_id",
    "direction_id",
    "trip_headsign",
    "shape_id",
    "service_id",
    "trip_id",
)

# --- Fixed values: stop detection -----------------------------------------
# A moving reading only counts if its id is less than this far below the stop end.
MAX_ID_GAP = 300
# Long stops: strictly between these many seconds.
LONG_STOP_MIN_S = 300
LONG_STOP_MAX_S = 7200
# Default date bounds of the fleet job.
DEFAULT_LOWER_BOUND = "2013-01-01 00:00:00"
DEFAULT_UPPER_BOUND = "2016-12-06 00:00:00"
# Hour and length of the stored "long afternoon stops" question.
AFTERNOON_HOUR = 16
AFTERNOON_MIN_S = 600

# --- Fixed values: report page sizes ---------------------------------------
CURRENT_TABLE_ROWS = 500
CURRENT_MAP_ROWS = 25
HISTORY_TABLE_ROWS = 300
HISTORY_HEAT_ROWS = 3000
