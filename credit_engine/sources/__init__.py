"""Where tables come from and how they become lending concepts."""
