"""Jobs: functions of a session and paths, with a command line each; and their queries with SQL."""
