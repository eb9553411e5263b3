"""Reading and writing of tables and models, table schemas and the test views."""
