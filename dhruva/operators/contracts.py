"""Slot contracts: which slots an operation may carry and what their values must look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TRIP = "origin destination via landmark locality route_number line_name transport_mode preference timing_type time temporal_relative date"
_TIMES = "origin destination station route_number line_name transport_mode timing_type time temporal_relative date"
# Slots each operation may carry (fixed values).
ALLOWED = {
    "point_to_point_route": _TRIP,
    "multimodal_route": _TRIP,
    "route_stop_sequence": "route_number line_name transport_mode",
    "route_stop_membership": "route_number line_name stop transport_mode",
    "first_and_last_service": _TIMES,
    "service_frequency": _TIMES,
    "scheduled_departure": _TIMES + " stop",
    "mode_availability": "origin destination via route_number line_name transport_mode time temporal_relative date",
    "fare_calculation": "origin destination route_number transport_mode ticket_type fare_type stage_number service_type",
    "ticketing_and_passes": "station transport_mode ticket_type",
    "station_facilities": "station transport_mode facility_type",
    "station_accessibility": "station transport_mode accessibility_feature",
    "interchange_transfer": "origin destination station route_number line_name transport_mode mode_from mode_to",
    "nearest_transport": "landmark locality transport_mode",
    "realtime_status_query": "origin destination station landmark locality route_number line_name transport_mode temporal_relative date",
}
ENTITY = ("origin", "destination", "via", "station", "stop", "landmark", "locality")
# All slots there are (fixed values).
SLOTS = (
    *ENTITY, "route_number", "line_name", "transport_mode", "mode_from", "mode_to", "preference", "timing_type", "time", "temporal_relative", "date",
    "ticket_type", "fare_type", "stage_number", "service_type", "facility_type", "accessibility_feature",
)
# What a question about something else carries is not forbidden.
ALLOWED["out_of_scope"] = " ".join(SLOTS)
_MODES = ("metro", "bus", "suburban_rail", "mrts", "any")
# Closed vocabularies (fixed values).
ENUM = {
    "transport_mode": _MODES,
    "mode_from": _MODES,
    "mode_to": _MODES,
    "preference": ("fastest", "cheapest", "least_transfers", "direct_only"),
    "timing_type": ("first", "last", "frequency", "departure", "operating_hours"),
    "ticket_type": ("token", "smart_card", "ncmc_card", "qr_ticket", "monthly_pass", "tourist_pass", "season_pass"),
    "fare_type": ("stage_fare", "distance_fare", "concession", "pass_fare"),
    "service_type": ("Ordinary Services", "Express Services", "Deluxe Services", "Night Services", "Air Conditioned Services"),
    "facility_type": ("parking", "interchange", "restroom", "waiting_room", "cloak_room", "atm", "wifi", "drinking_water"),
    "accessibility_feature": ("wheelchair", "lift", "escalator", "ramp", "accessible_toilet", "tactile_paths", "any"),
    "line_name": ("Blue Line", "Green Line", "Corridor 1", "Corridor 2", "MRTS", "North Line", "South Line", "West Line"),
}


def allowed_slots(spark) -> DataFrame:
    rows = [(i, s) for i, slots in ALLOWED.items() for s in slots.split()]
    return spark.createDataFrame(rows, "operation string, slot string")


def forbidden(slots: DataFrame) -> DataFrame:
    """Rows ``(operation, slot, ..)`` whose slot the operation may not carry; unknown operations may carry none."""
    return slots.join(F.broadcast(allowed_slots(slots.sparkSession)), ["operation", "slot"], "left_anti")


def reason(slot: Column, value: Column) -> Column:
    """Why a slot's value is invalid; null if it is valid. A null value says nothing and is valid, a null slot is unknown."""
    bad = F.when(slot.isNull() | ~slot.isin(*SLOTS), "unknown_slot").when(value.isNull(), None)
    bad = bad.when(slot.isin(*ENTITY) & ~value.rlike("^[A-Z0-9_]+$"), "entity_id")
    bad = bad.when((slot == "route_number") & ~value.rlike("^[A-Z0-9][A-Z0-9#-]*$"), "route_code")
    bad = bad.when((slot == "time") & ~value.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"), "clock")
    bad = bad.when((slot == "date") & (~value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | F.try_to_date(value, "yyyy-MM-dd").isNull()), "date")
    bad = bad.when((slot == "stage_number") & ~(value.rlike("^[0-9]{1,2}$") & value.try_cast("int").between(1, 30)), "stage")
    bad = bad.when((slot == "temporal_relative") & (F.trim(value) == ""), "blank")
    for name, words in ENUM.items():
        bad = bad.when((slot == name) & ~value.isin(*words), "vocabulary")
    return bad
