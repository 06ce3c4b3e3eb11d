"""Named queries over whole tables, each with the SQL it must agree with where SQL can express it."""
