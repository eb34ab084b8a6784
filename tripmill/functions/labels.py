"""Vocabularies: fixed values of labels, road types and their parameters."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The road type of each highway tag.
HIGHWAY_TO_ROAD_TYPE = {
    "motorway": "motorway", "motorway_link": "motorway", "trunk": "motorway", "trunk_link": "motorway",
    "primary": "primary", "primary_link": "primary", "secondary": "secondary", "secondary_link": "secondary", "tertiary": "tertiary", "tertiary_link": "tertiary",
    "residential": "residential", "living_street": "residential", "unclassified": "residential", "road": "residential",
    "service": "service", "track": "service", "path": "service", "footway": "service", "cycleway": "service", "pedestrian": "service", "steps": "service",
    "construction": "other", "bus_guideway": "other", "escape": "other", "raceway": "other", "rest_area": "other",
    "bridleway": "service", "corridor": "service", "platform": "service", "proposed": "other", "busway": "service", "elevator": "service", "service_area": "service",
}
#: km/h bounds and least seconds of a speed plateau by road type.
PLATEAUS = {"motorway": (100, 120, 15), "primary": (60, 90, 12), "secondary": (45, 70, 10), "tertiary": (35, 55, 10), "service": (40, 60, 8), "residential": (25, 40, 8), "unknown": (10, 35, 5)}
#: The category of each event.
EVENT_CATEGORIES = {
    "nid_de_poule": "infra", "dos_d_ane": "infra", "ralentisseur": "infra", "virage_serre": "infra", "rond_point": "infra",
    "acceleration_initiale": "behavior", "freinage_fort": "behavior", "demarrage_cote": "behavior", "manoeuvre_stationnement": "behavior",
    "zone_urbaine_dense": "context", "zone_residentielle": "context", "meteo_pluie": "context", "meteo_vent": "context", "travaux": "context",
}
#: Other spellings of a label.
ALIASES = {"dos_d_ane": "dos_dane", "dos_d'ane": "dos_dane", "speed_bump": "dos_dane", "STOP": "stop", "WAIT": "wait", "stop_start": "stop", "wait_start": "wait", "freinage_final": "final_deceleration", "deceleration_finale": "final_deceleration", "acceleration_initiale": "initial_acceleration"}
#: Point events, road types from fast to slow, and cooldown seconds and metres by event type.
POINT_EVENTS = ("freinage", "acceleration", "trottoir", "nid_de_poule", "dos_dane")
ROAD_ORDER = ("motorway", "primary", "secondary", "tertiary", "residential", "service")
EVENT_RULES = {"brake": (0.8, 8.0), "accel": (0.8, 8.0), "speed_bump": (1.0, 12.0), "pothole": (0.7, 10.0), "curb": (0.7, 10.0)}


def lookup(mapping: dict, key: Column) -> Column:
    """The value of a literal map; null for a missing key."""
    return F.element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(mapping.items()))), key)


def is_blank(event: Column) -> Column:
    return event.isNull() | (F.trim(event) == "")
