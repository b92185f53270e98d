"""Tag normalisation and classification as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Use class of building types; of any other type it is unknown.
USE_CLASS = {
    "residential": ("house", "residential", "detached", "terrace", "apartments"),
    "commercial": ("commercial", "retail", "office", "warehouse", "hotel"),
    "industrial/institutional": ("industrial", "school", "church", "hospital", "public"),
}
#: Storeys that a height in metres stands for, up to 6, up to 15 and beyond.
HEIGHT_TIERS = ("unknown", "1-2", "3-5", "6+")
#: Seconds lost at intersections of kinds 1 to 4.
DELAYS = {1: 20, 2: 4, 3: 3, 4: 2}
#: Metres a second by profile.
SPEEDS = {"driving": 15.0, "cycling": 5.0, "walking": 1.4}
#: Operating status codes.
STATUS = {0: "open", 1: "temporarily_closed", 2: "closed"}


def speed_kmh(text: Column) -> Column:
    """The leading number of a speed limit; miles are converted, 255 is the largest."""
    number = F.split(text, " ")[0].try_cast("int")
    kmh = F.when(text.contains("mph"), F.rint(number * 1.60934)).otherwise(number.cast("double"))
    return F.when(kmh > 255, F.lit(255.0)).otherwise(kmh).cast("int")


def oneway(text: Column) -> Column:
    """1 along the way, -1 against it, 0 both ways."""
    return F.when(text.isin("yes", "true", "1"), 1).when(text.isin("-1", "reverse"), -1).otherwise(0)


def lanes(text: Column) -> Column:
    """A whole number, 255 at most; anything else gives none."""
    number = F.trim(text).try_cast("int")
    return F.when(number > 255, 255).otherwise(number)


def bridge_tunnel(bridge: Column, tunnel: Column) -> Column:
    """A tunnel comes before a bridge; only these values name one."""
    return F.when(tunnel.isin("yes", "building_passage"), "tunnel").when(bridge.isin("yes", "viaduct"), "bridge")


def height(text: Column) -> Column:
    return F.rtrim(text, F.lit("m ")).try_cast("double")


def height_tier(metres: Column) -> Column:
    none, low, mid, high = HEIGHT_TIERS
    return F.when(metres.isNull() | (metres <= 0), none).when(metres <= 6, low).when(metres <= 15, mid).otherwise(high)


def use_class(building_type: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, types in USE_CLASS.items():
        out = out.when(building_type.isin(*types), name)
    return out.otherwise("unknown")


#: Fixed values: (tag, values that it may have, water type), the first that holds decides.
WATER_RULES = (
    ("water", ("reservoir",), "reservoir"), ("water", ("pond",), "pond"), ("water", ("river",), "river"), ("waterway", ("river", "riverbank"), "river"),
    ("waterway", ("stream",), "stream"), ("waterway", ("creek",), "creek"), ("waterway", ("canal", "ditch"), "canal"), ("waterway", ("drain",), "drain"),
    ("water", ("bay",), "bay"), ("natural", ("coastline",), "ocean"), ("natural", ("wetland",), "wetland"), ("water", ("wetland",), "wetland"),
    ("water", ("marsh",), "marsh"), ("water", ("swamp",), "swamp"), ("water", ("estuary",), "estuary"),
)


def water_type(natural: Column, water: Column, waterway: Column) -> Column:
    """First rule that holds: a lake is named as such or is water of no further kind; what no rule knows is a stream if it is a waterway, else a lake."""
    tags = {"natural": natural, "water": water, "waterway": waterway}
    out = F.when((water == "lake") | ((natural == "water") & (F.coalesce(water, F.lit("")) == "")), "lake")
    for tag, values, name in WATER_RULES:
        out = out.when(tags[tag].isin(*values), name)
    return out.when(F.coalesce(waterway, F.lit("")) != "", "stream").otherwise("lake")


def place_kind(tag: Column) -> Column:
    """Place types; whatever else is a neighborhood."""
    return F.when(tag.isin("city", "town", "village", "hamlet", "suburb"), tag).otherwise("neighborhood")


def rail_kind(tag: Column) -> Column:
    return F.when(tag == "preserved", "rail").otherwise(tag)


def delay_s(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in DELAYS.items() for x in kv])[kind.cast("int")]


def speed_ms(profile: str) -> float:
    return SPEEDS.get(profile, SPEEDS["driving"])


def status(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[code.cast("int")]


def status_compat(closed_bit: Column, website_bit: Column) -> Column:
    """The literal decoding, where the two bits of a closed business with a website read as temporarily closed."""
    return F.when(closed_bit & website_bit, "temporarily_closed").when(closed_bit, "closed").otherwise("open")


def visible(road_class: Column, zoom: int) -> Column:
    """Whether a map shows the class at a zoom."""
    minor = road_class.isin("residential", "service", "footway", "cycleway", "path", "track", "unclassified", "living_street")
    if zoom < 11:
        return ~(minor | (road_class == "tertiary"))
    return ~minor if zoom < 13 else F.lit(True)
