"""Logical tables and the class vocabulary.

Times are bigint microseconds since 1970 in UTC (columns ending in _us), so that gaps and
slacks are exact integers; `functions.times` converts from and to timestamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS = "event_id long, camera_id long, track_id long, kind string, at_us long, payload string"
CAMERAS = "camera_id long, slug string, enabled boolean, idle_fps double, maintain_conf double, light_condition string, color string"
TRACKS = (
    "track_id long, camera_id long, local_track_id int, class_id int, class_name string, started_us long, ended_us long, n_observations int, "
    "global_id string, identity_name string, identity_kind string, face_verified boolean, plate_text string, ever_active boolean, "
    "came_to_rest boolean, suppressed_reason string, retain_until_us long, embedding array<float>, thumbnail string"
)
SAMPLES = "sample_id long, camera_id long, local_track_id int, track_id long, captured_us long, confidence double, bbox array<double>, embedding array<float>, face_score double, face_frontality double, face_realigned boolean, at_rest boolean, face_model string"
RECORDINGS = "recording_id long, camera_id long, started_us long, ended_us long, size_bytes long, codec string, retain_until_us long"
ZONES = "zone_id long, camera_id long, kind string, polygon array<struct<x:double,y:double>>, rules map<string,struct<min_confidence:double,min_dwell_ms:long,motion_gate:string>>"
OCCUPANCY = "place string, occupied_us long, released_us long, global_id string, evidence string, plate_read_id long, cameras array<long>"
PRESENCE = "episode_id long, global_id string, camera_id long, evidence string, present_us long, confirmed_us long, departed_us long, closed_by string"
PLATE_READS = "read_id long, camera_id long, track_id long, place string, read_us long, plate_text string, readings int, ocr_score double, global_id string"
TELEMETRY = "at_us long, camera_id long, source string, payload string"
TRACK_STREAM = (
    "camera_id long, sequence long, timestamp_us long, epoch long, tracks array<struct<track_id:int,x1:double,y1:double,x2:double,y2:double,"
    "class_id:int,class_name:string,confidence:double,motion_state:string,first_seen_us:long,last_matched_us:long,continues_track_id:int>>"
)

#: The 80 class names of the common detection vocabulary, by id.
CLASS_NAMES = (
    "person|bicycle|car|motorcycle|airplane|bus|train|truck|boat|traffic light|fire hydrant|stop sign|parking meter|bench|bird|cat|dog|"
    "horse|sheep|cow|elephant|bear|zebra|giraffe|backpack|umbrella|handbag|tie|suitcase|frisbee|skis|snowboard|sports ball|kite|"
    "baseball bat|baseball glove|skateboard|surfboard|tennis racket|bottle|wine glass|cup|fork|knife|spoon|bowl|banana|apple|sandwich|"
    "orange|broccoli|carrot|hot dog|pizza|donut|cake|chair|couch|potted plant|bed|dining table|toilet|tv|laptop|mouse|remote|keyboard|"
    "cell phone|microwave|oven|toaster|sink|refrigerator|book|clock|vase|scissors|teddy bear|hair drier|toothbrush"
).split("|")
PERSON = 0
VEHICLES = (2, 3, 5, 7)
PETS = (15, 16)
ANIMALS = tuple(range(14, 24))
BICYCLE = 1


def class_dim(spark: SparkSession) -> DataFrame:
    """class_id, class_name and its four groupings; 80 rows, always small enough to broadcast.

    reid_group pools classes that stand for one object; canonical counts a bicycle as a vehicle;
    heat_group does not; ui_group keeps it apart.
    """
    rows = []
    for i, name in enumerate(CLASS_NAMES):
        reid = "vehicle" if i in VEHICLES else "pet" if i in PETS else f"class-{i}"
        plain = "person" if i == PERSON else "vehicle" if i in VEHICLES else "animal" if i in ANIMALS else "other"
        rows.append((i, name, reid, "vehicle" if i == BICYCLE else plain, plain, "bicycle" if i == BICYCLE else plain))
    return spark.createDataFrame(rows, "class_id int, class_name string, reid_group string, canonical string, heat_group string, ui_group string")
