"""Named queries over the test tables, each with its SQL twin where there is one."""
