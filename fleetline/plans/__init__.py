"""Named end-to-end plans over the given tables (see ``catalog``) and their
independent DuckDB SQL twins (see ``oracle``)."""
