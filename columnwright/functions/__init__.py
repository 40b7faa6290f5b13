"""Row-wise expressions: functions from Columns to a Column."""
