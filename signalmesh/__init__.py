"""signalmesh: feedback triangulation as Spark DataFrame jobs.

Two feeds of customer signals -- support tickets (reactive) and feature
requests (proactive) -- are redacted, tagged with keyword themes, scored,
ranked and mined for emerging n-gram themes.  Every operator takes and
returns DataFrames; nothing is pulled to the driver except configuration
and one boolean per round of the emerging-theme loop.
"""

from signalmesh.params import Params
from signalmesh.config import ThemesConfig, ThemeDef, DEFAULT_THEMES, FIXTURE_THEMES

__all__ = ["Params", "ThemesConfig", "ThemeDef", "DEFAULT_THEMES", "FIXTURE_THEMES"]
