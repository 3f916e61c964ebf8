"""farebox: transit-ridership analytics on Spark.

Hourly station counts are cleaned, filtered to service hours, split
reproducibly, modelled and scored with DataFrame operations; profiles,
options listings, context fusion and the map dimension are built the same
way. Every public function takes and returns ``DataFrame`` or ``Column``.
"""

from farebox.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
