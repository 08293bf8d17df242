"""All queries: importing their modules registers them."""

from waybill.plans import events, history, journeys, lines, places, records, relations, routes  # noqa: F401
from waybill.plans.registry import QUERIES, SQL  # noqa: F401
