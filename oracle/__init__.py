"""Independent SQL for every registered query, for a second engine on the same tables."""

from oracle import core, jobs

SQL = {**core.SQL, **jobs.SQL}
