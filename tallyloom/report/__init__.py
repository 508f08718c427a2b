"""Reports: views of links, batches of links, the stack of their results, chains of tables, and sheets."""
